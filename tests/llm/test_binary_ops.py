import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import media, warc
from larkspur.llm.common import new_path

PAGES = [
    (1, "http://a/x y\n", "same"), (2, None, "same"), (3, "http://b/", None), (4, "http://b/", ""), (5, "u", "é" * 700), (5, "u", "é" * 700), (6, "u", "é" * 700), (7, "u", "a\r\n\r\nb"), (None, "u", "same"), (None, "u", "alone"),
    (8, "u", "WARC/1.1\r\n\r\n" * 300),
]


def pages(spark):
    return spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, record int, digest string")


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_archive_round_trip(spark, chunk):
    folder = new_path(spark, "w")
    warc.write(pages(spark), folder, chunk=chunk)
    got = sorted(warc.read(spark, folder).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"]))
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        of = first.get(h or "")
        revisit = of is not None and i != of
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", of if revisit else None))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got] == want
    assert got[0]["url"] == "http://a/x%20y%0A" and got[1]["url"] == "urn:page:2"
    rows = spark.read.parquet(folder)
    assert rows.agg(F.max(F.length("data"))).first()[0] <= chunk + 700
    assert warc.read(spark, folder).count() == len(PAGES)


def test_small_payloads_are_all_responses(spark):
    folder = new_path(spark, "w")
    warc.write(pages(spark), folder, min_revisit_bytes=5)
    kinds = {(r["page_id"], r["payload_bytes"]): r["record_type"] for r in warc.read(spark, folder).collect()}
    assert kinds[(2, 4)] == "response" and kinds[(6, 1400)] == "revisit"


def test_a_damaged_chunk_is_met(spark):
    folder, bad = new_path(spark, "w"), new_path(spark, "w")
    warc.write(pages(spark).where("page_id = 5").limit(1), folder, chunk=64)
    rows = spark.read.parquet(folder)
    broken = F.when(F.col("chunk_no") == 3, F.lit(b"x" * 64)).otherwise(F.col("data"))
    rows.withColumn("data", broken).write.parquet(bad)
    with pytest.raises(Exception, match="damaged before the end of chunk 3"):
        warc.read(spark, bad).collect()


def test_empty_archive(spark):
    folder = new_path(spark, "w")
    warc.write(pages(spark).where("false"), folder)
    assert warc.read(spark, folder).count() == 0


def packed(codes, size):
    """A bit stream of LZW codes, written one bit after another."""
    bits, width, entry, clear = [], size + 1, (1 << size) + 2, 1 << size
    started = False
    for c in codes:
        bits += [c >> i & 1 for i in range(width)]
        if c == clear:
            width, entry, started = size + 1, (1 << size) + 2, False
            continue
        if started and entry < 4096:
            entry += 1
            if entry == 1 << width and width < 12:
                width += 1
        started = True
    bits += [0] * (-len(bits) % 8)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


def simple_lzw(data, size, deferred=False):
    """LZW by its definition over tuples."""
    clear, end = 1 << size, (1 << size) + 1
    codes, table = [clear], {(i,): i for i in range(clear)}
    entry, w = end + 1, ()
    for s in data:
        if (*w, s) in table:
            w = (*w, s)
            continue
        codes.append(table[w])
        if entry < 4096:
            table[(*w, s)] = entry
            entry += 1
        elif not deferred:
            codes.append(clear)
            table, entry = {(i,): i for i in range(clear)}, end + 1
        w = (s,)
    return [*codes, *([table[w]] if w else []), end]


@pytest.mark.parametrize("size", [2, 3, 5, 8])
@pytest.mark.parametrize("deferred", [False, True])
def test_lzw_streams(size, deferred):
    rng = np.random.default_rng(size)
    for n in (0, 1, 2, 500, 60_000):
        for data in (rng.integers(0, 1 << size, n), np.zeros(n, int), rng.integers(0, 2, n)):
            data = data.tolist()
            assert list(media.lzw_decode(packed(simple_lzw(data, size, deferred), size), size, n)) == data


def test_own_streams_are_standard():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", bytes(50_000), rng.integers(0, 256, 40_000).astype(np.uint8).tobytes()):
        assert media.lzw_codes(data) == simple_lzw(list(data), 8)
        for size in (2, 5, 8):
            low = bytes(x & ((1 << size) - 1) for x in data)
            assert media.lzw_pack(media.lzw_codes(low, size), size) == packed(simple_lzw(list(low), size), size)


def gif(frames, width=4, height=4, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    """A GIF of (left, top, rows of indexes, delay, disposal, clear index, own palette, interlaced)."""
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf1\0\0", bytes(x for c in palette for x in c), b"\x21\xfe\x02hi\0"]
    for left, top, rows, delay, disposal, clear, own, interlaced in frames:
        flags = disposal << 2 | (clear is not None)
        out += [b"\x21\xf9\x04", bytes([flags]), delay.to_bytes(2, "little"), bytes([clear or 0]), b"\0"]
        out += [b"\x2c", *(x.to_bytes(2, "little") for x in (left, top, len(rows[0]), len(rows))), bytes([(0x81 if own else 0) | 0x40 * interlaced])]
        if own:
            out.append(bytes(x for c in own for x in c))
        order = [*range(0, len(rows), 8), *range(4, len(rows), 8), *range(2, len(rows), 4), *range(1, len(rows), 2)] if interlaced else range(len(rows))
        out += [b"\x02", media._blocks(packed(simple_lzw([x for r in order for x in rows[r]], 2), 2))]
    return b"".join((*out, b"\x3b"))


def shown(frame):
    """Red 1, green 2, blue 3, black 0, nothing -1."""
    colours = {(0, 0, 0): 0, (255, 0, 0): 1, (0, 255, 0): 2, (0, 0, 255): 3, (9, 9, 9): 9}
    return [[colours[tuple(int(v) for v in p[:3])] if p[3] else -1 for p in row] for row in frame.canvas]


def test_disposal_and_transparency():
    full = [[1] * 4] * 4
    data = gif([
        (0, 0, full, 5, 1, None, None, 0), (1, 1, [[2, 0], [0, 2]], 7, 3, 0, None, 0), (0, 0, [[3]], 9, 2, None, None, 0), (3, 3, [[2, 2], [2, 2]], 1, 0, None, None, 0), (0, 3, [[0]], 0, 0, None, ((9, 9, 9), (0, 0, 0), (0, 0, 0), (0, 0, 0)), 0),
    ])
    seen = [(shown(f), f.at_ms, f.delay_ms) for f in media.frames(data)]
    red = [[1] * 4 for _ in range(4)]
    second = [list(r) for r in red]
    second[1][1] = second[2][2] = 2  # index 0 is clear: red stays
    third = [list(r) for r in red]  # the second was taken back
    third[0][0] = 3
    fourth = [list(r) for r in red]
    fourth[0][0] = -1  # the third was cleared
    fourth[3][3] = 2  # cut at the edge
    fifth = [list(r) for r in fourth]
    fifth[3][0] = 9
    assert seen == [(red, 0, 50), (second, 50, 70), (third, 120, 90), (fourth, 210, 10), (fifth, 220, 0)]


def test_interlaced_rows():
    rows = [[i % 4] * 4 for i in range(4)]
    (f,) = media.frames(gif([(0, 0, rows, 0, 0, None, None, 1)]))
    assert shown(f) == rows


def test_frames_in_spark(spark):
    good = gif([(0, 0, [[1] * 4] * 4, 5, 1, None, None, 0), (0, 0, [[2]], 5, 1, None, None, 0)])
    rows = spark.createDataFrame([(1, good), (2, None), (3, b"no"), (4, good[:40])], "id long, media binary")
    got = {(r["id"], r["frame"]): r for r in media.decode_frames(rows, bins=2).collect()}
    assert got[(1, 0)]["hist_red"] == [0, 16] and got[(1, 1)]["hist_green"] == [15, 1] and got[(1, 1)]["at_ms"] == 50
    assert all(got[(i, None)]["error"] for i in (2, 3, 4))
    # Early ends after a frame give that frame and an error; hostile sizes an error before memory is taken.
    hostile = [(5, good[:-10]), (6, good[:6] + b"\xff\xff\xff\xff" + good[10:]), (7, gif([(0, 0, [[1] * 4] * 4, 5, 1, None, None, 0)]).replace(b"\x2c\0\0\0\0\x04\0\x04\0", b"\x2c\0\0\0\0\xff\xff\xff\xff"))]
    told = sorted((r["id"], r["frame"] is None, (r["error"] or "")[:5]) for r in media.decode_frames(spark.createDataFrame(hostile, "id long, media binary")).collect())
    assert told == [(5, False, ""), (5, True, "the G"), (6, True, "65535"), (7, True, "65535")]
    assert media.decode_frames(rows.where("false")).count() == 0


def test_stored_animations_use_palettes_disposal_and_transparency():
    rng = np.random.default_rng(4)
    row = [rng.integers(0, 200, 64).astype(np.uint8).tobytes() for _ in range(4)]
    payload = b"".join(row[i % 4] for i in range(media.ROWS * 3 + 5))
    data = media.gif_of(payload)
    got = list(map(lambda f: (media.payload_of(f), f.at_ms, f.delay_ms, f.disposal, media.histograms(f.canvas, 4).sum()), media.frames(data)))
    assert b"".join(g[0] for g in got) == payload
    assert [g[1:4] for g in got] == [(0, 100, 1), (100, 100, 3), (200, 100, 2), (300, 100, 1)]
    assert len(data) < len(payload) // 4  # repeated rows are clear
    flags = [data[m.start() + 3] for m in re.finditer(rb"\x21\xf9\x04", data)]
    assert flags[1] & 1 and flags[2] & 1  # over the first frame, which was left and put back
    own = [data[m.start() + 9] for m in re.finditer(rb"\x2c\0\0\0\0\x40\0", data)]
    assert [x >> 7 for x in own] == [0, 1, 0, 1]
    every = bytes(range(256)) * 3  # no index is left for the transparent one
    assert b"".join(media.payload_of(f) for f in media.frames(media.gif_of(every))) == every
    assert len(list(media.frames(media.gif_of(bytes(64))))) == 1 and len(list(media.frames(media.gif_of(bytes(128))))) == 2


def test_payloads(spark, odd, none):
    got = media.media_columns(odd).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    for r in got:
        if r["id"] is None:
            continue
        text = texts[r["id"]]
        body = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert sum(r["hist_grey"]) == len(body)
        high = min(-(-len(body) // 128), media.ROWS)
        assert [f["at_ms"] for f in r["frames"]] == [100 * k for k in range(r["n_frames"])] and {f["delay_ms"] for f in r["frames"]} == {100}
        # The first frame by brute force: red is the sample, green its complement, blue five times it.
        first = body[: 64 * high]
        for name, of in (("hist_red", lambda v: v), ("hist_green", lambda v: 255 - v), ("hist_blue", lambda v: 5 * v % 256)):
            assert r["frames"][0][name] == [sum(of(v) >> 4 == b for v in first) for b in range(16)]
    same = {(r["media_sha256"], r["feature"]) for r in got if r["id"] in (5, 6)}
    assert len(same) == 1
    assert {r["id"]: r["n_frames"] for r in got}[7] == 3
    assert media.media_columns(none).count() == 0
