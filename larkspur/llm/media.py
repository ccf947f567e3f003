"""GIF media columns: LZW streams, palettes, disposal, transparency, timed frames, histograms.

``decode_frames`` reads GIF87a and GIF89a values and gives one row per frame as it is shown: the
composed canvas, its time, and colour histograms. ``store`` writes any payload as the red samples
of an animation, 64 samples a row, in two frames or more: even frames use the shared palette, odd
ones a palette of their own of just the colours they have; a row that the canvas already shows is
written in the transparent index; and frames are left, taken back or cleared by turns. A frame has
at most ``ROWS`` rows and only one is in memory at a time. ``read_payload`` composes the canvas again
by the same decoder and takes the payload, the times and the colour histograms from it.

LZW: the code width follows from a code's place after the last clear code, so codes are unpacked
by array operations. The entry a code makes is the text of that code and the first sample of the
next; a block between clear codes is decoded code by code over the list of its entries.

Defined results: a null or empty payload is one row of zeros; repeated rows get equal bytes; an
empty table gives an empty table; a null GIF gives one row with ``error`` set and no frame; a
damaged one gives the frames before the damage and then such a row; so does one whose canvas or
frame has more samples than a parameter allows, before memory is taken for it; a frame partly
outside the canvas is cut at its edge; extra columns are ignored. A very long text becomes many frames.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import column, ship, sliced, staged

WIDTH, ROWS = 64, 4096
#: A stored frame is shown for this long, in hundredths of a second.
DELAY = 10
#: Samples of a canvas or a frame beyond which a GIF is refused: a canvas takes four bytes a sample.
MOST_SAMPLES = 1 << 24
#: Colours of the samples 0 to 255: red is the sample itself.
_COLOURS = np.stack([np.arange(256), 255 - np.arange(256), 5 * np.arange(256) % 256], 1).astype(np.uint8)
_SHARED = _COLOURS.tobytes()
#: How frames are disposed of by turns: left, taken back, cleared.
_DISPOSALS = (1, 3, 2)
_MOST = 4096


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, for a minimum code size."""
    at = np.arange(n)
    entries = np.minimum(np.maximum(at + (1 << size) + 1, (1 << size) + 2), _MOST - 1)
    return np.maximum(np.floor(np.log2(entries)).astype(np.int64) + 1, size + 1)


_WIDTHS = {size: _widths(1 << 14, size) for size in range(2, 9)}


#: Code of each (code, sample) while a stream is made, 0 for none; all 0 between streams.
_TABLE = [0] * (_MOST << 8)


def lzw_codes(data: bytes, size: int = 8) -> list[int]:
    """The codes of samples of ``size`` bits, clearing whenever the table is full."""
    clear, first = 1 << size, (1 << size) + 2
    codes, table, keys, entry = [clear], _TABLE, [], first
    put, made = codes.append, keys.append
    samples = iter(data)
    w = next(samples, None)
    if w is None:
        return [clear, clear + 1]
    for b in samples:
        key = w << 8 | b
        if c := table[key]:
            w = c
            continue
        put(w)
        if entry < _MOST:
            table[key] = entry
            made(key)
            entry += 1
        else:
            put(clear)
            for key in keys:
                table[key] = 0
            keys.clear()
            entry = first
        w = b
    for key in keys:
        table[key] = 0
    put(w)
    put(clear + 1)
    return codes


def lzw_pack(codes: list[int], size: int = 8) -> bytes:
    """Codes of a minimum size as a bit stream."""
    c = np.frombuffer(array("H", codes), np.uint16)
    clear = np.flatnonzero(c == 1 << size)
    since = np.arange(-1, len(c) - 1)
    if len(clear) > 1:
        since = np.arange(len(c)) - np.repeat(clear + 1, np.diff(np.append(clear, len(c))))  # -1 at a clear code
        # A clear code is as wide as the code that would stand in its place.
        since[clear[1:]] = since[clear[1:] - 1] + 1
    since[0] = 0
    width = _WIDTHS[size].take(since, mode="clip")
    bits = np.unpackbits(c.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    # Neighbours are mostly of one width, so the bits are taken run by run.
    ends = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), len(c)]
    return np.packbits(np.concatenate([bits[i:j, : width[i]].ravel() for i, j in zip(ends, ends[1:], strict=False)]), bitorder="little").tobytes()


_BASE = {size: [bytes([x]) for x in range(1 << size)] + [b"", b""] for size in range(2, 9)}


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """At most ``most`` samples of an LZW stream of a minimum code size."""
    if not 2 <= size <= 8:
        raise ValueError("an LZW code size out of range")
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, bit, made, parts = 8 * len(stream), 0, 0, []
    while bit < total and made < most:
        # Codes up to the next clear code; the table never outgrows the block's start.
        table = _BASE[size].copy()
        last, done, ended = b"", 0, False
        while True:
            # Codes have more than ``size`` bits, so no more than these are left.
            most_codes = min(_MOST, (total - bit) // (size + 1) + 1)
            w = _WIDTHS[size][done : done + most_codes] if done + most_codes <= len(_WIDTHS[size]) else np.full(most_codes, 12)
            at = bit + np.cumsum(w) - w
            k = int(np.searchsorted(at + w, total, "right"))
            at, w = at[:k], w[:k]
            codes = words[at >> 3] >> (at & 7).astype(np.uint32) & ((1 << w) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            n = int(stop[0]) if len(stop) else k
            last, gained = _texts(codes[:n].tolist(), table, last, parts)
            made += gained
            if len(stop):
                bit, ended = int(at[n] + w[n]), int(codes[n]) == end
                break
            if k < most_codes or k < _MOST or made >= most:
                ended = True
                break
            bit, done = int(at[-1] + w[-1]), done + _MOST
        if ended:
            break
    return b"".join(parts)[:most]


def _texts(codes: list[int], table: list[bytes], last: bytes, parts: list[bytes]) -> tuple[bytes, int]:
    """Appends the texts of codes to ``parts`` and their entries to ``table``; (text of the last code, number of samples)."""
    put, enter, at, before = parts.append, table.append, 0, len(parts)
    if codes and not last:
        last = _known(table, codes[0])
        put(last)
        at = 1
    room = at + _MOST - len(table)
    for c in codes[at:room]:
        try:
            text = table[c]
        except IndexError:
            if c != len(table):
                raise ValueError("an LZW code before its entry") from None
            text = last + last[:1]
        enter(last + text[:1])
        put(text)
        last = text
    for c in codes[max(at, room) :]:  # the table is full
        last = table[c]
        put(last)
    return last, sum(map(len, parts[before:]))


def _known(table: list[bytes], code: int) -> bytes:
    if code >= len(table):
        raise ValueError("an LZW code before its entry")
    return table[code]


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (stream[i : i + 255] for i in range(0, len(stream), 255))) + b"\0"


def gif_of(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a GIF89a whose red samples, frame after frame, are the payload."""
    rows = len(payload) // WIDTH
    if not rows or len(payload) % WIDTH:
        raise ValueError("the payload isn't a positive multiple of 64 bytes")
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    high = min(-(-rows // 2), ROWS)
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), high.to_bytes(2, "little"), b"\xf7\0\0", _SHARED]
    under = np.zeros((high, WIDTH), np.uint8)  # what the canvas shows, where it shows something
    shows = np.zeros(high, bool)
    for number, at in enumerate(range(0, rows, high)):
        frame = samples[at : at + high]
        n, disposal = len(frame), _DISPOSALS[number % 3]
        same = shows[:n] & (frame == under[:n]).all(1)
        there = np.bincount(frame.ravel(), minlength=256) > 0
        index, palette, size, clear = frame, b"\0", 8, None
        if number % 2 and (own := int(there.sum())) < 256:
            size = max(2, own.bit_length())  # one index more than colours
            index = (np.cumsum(there) - 1).astype(np.uint8)[frame]
            palette = bytes([0x80 | size - 1]) + _COLOURS[there].tobytes() + bytes(3 * ((1 << size) - own))
            clear = own
        elif not there.all():
            clear = int(np.argmin(there))
        if clear is not None and same.any():
            index = np.where(same[:, None], np.uint8(clear), index)
        else:
            clear = None
        out += [b"\x21\xf9\x04", bytes([disposal << 2 | (clear is not None)]), DELAY.to_bytes(2, "little"), bytes([clear or 0]), b"\0"]
        out += [b"\x2c\0\0\0\0", WIDTH.to_bytes(2, "little"), n.to_bytes(2, "little"), palette, bytes([size])]
        out.append(_blocks(lzw_pack(lzw_codes(index.tobytes(), size), size)))
        if disposal == 1:
            under[:n], shows[:n] = frame, True
        elif disposal == 2:
            shows[:n] = False
    return b"".join((*out, b"\x3b"))


@dataclass
class Frame:
    number: int
    at_ms: int
    delay_ms: int
    disposal: int
    box: tuple[int, int, int, int]  # left, top, width, height
    canvas: np.ndarray  # height x width x 4: red, green, blue, shown


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the GIF ends early")
        self.at += n
        return out

    def number(self, n: int = 2) -> int:
        return int.from_bytes(self.take(n), "little")

    def blocks(self) -> bytes:
        out = []
        while n := self.number(1):
            out.append(self.take(n))
        return b"".join(out)

    def palette(self, flags: int) -> np.ndarray:
        n = 2 << (flags & 7)
        full = np.full((256, 4), 255, np.uint8)  # every colour is shown
        full[n:, :3] = 0
        full[:n, :3] = np.frombuffer(self.take(3 * n), np.uint8).reshape(-1, 3)
        return full


def _row_order(height: int) -> np.ndarray:
    """Where the rows of an interlaced image go."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _bounded(width: int, height: int, most: int) -> None:
    if width * height > most:
        raise ValueError(f"{width} x {height} samples are more than {most}")


def frames(data: bytes, most: int = MOST_SAMPLES) -> Iterator[Frame]:
    """The frames of a GIF as shown; a canvas holds until the next frame is asked for."""
    src = _Bytes(data)
    if src.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags = src.number(), src.number(), src.number(1)
    _bounded(width, height, most)
    src.take(2)  # the background index: viewers clear to transparent, and so does this
    shared = src.palette(flags) if flags & 0x80 else None
    canvas = np.zeros((height, width, 4), np.uint8)
    number = at_ms = delay = disposal = 0
    clear = None
    while (kind := src.number(1)) != 0x3B:
        if kind == 0x21:
            label = src.number(1)
            body = src.blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = src.number(), src.number(), src.number(), src.number(), src.number(1)
        _bounded(w, h, most)
        palette = src.palette(flags) if flags & 0x80 else shared
        if palette is None:
            raise ValueError("a frame without a palette")
        size = src.number(1)
        got = lzw_decode(src.blocks(), size, w * h)
        index, shown = np.frombuffer(got.ljust(w * h, b"\0"), np.uint8).reshape(h, w), None
        if len(got) < w * h:
            shown = np.zeros(w * h, bool)
            shown[: len(got)] = True
            shown = shown.reshape(h, w)
        if flags & 0x40:
            order = _row_order(h)
            index = index[np.argsort(order)]
            if shown is not None:
                shown[order] = shown.copy()
        there = canvas[top : top + h, left : left + w]
        index = index[: there.shape[0], : there.shape[1]]
        before = there.copy() if disposal == 3 else None
        if clear is None and shown is None:
            there[:] = palette.take(index, 0)
        else:
            seen = np.ones(index.shape, bool) if shown is None else shown[: there.shape[0], : there.shape[1]].copy()
            if clear is not None:
                seen &= index != clear
            there[seen] = palette[index[seen]]
        yield Frame(number, at_ms, 10 * delay, disposal, (left, top, w, h), canvas)
        if disposal == 2:
            there[:] = 0
        elif disposal == 3:
            there[:] = before
        number, at_ms = number + 1, at_ms + 10 * delay
        delay, disposal, clear = 0, 0, None


def payload_of(frame: Frame) -> bytes:
    """The samples that ``gif_of`` put into a frame."""
    _, _, w, h = frame.box
    return frame.canvas[:h, :w, 0].tobytes()


def histograms(canvas: np.ndarray, bins: int) -> np.ndarray:
    """Three rows, red, green and blue, of the counts of a canvas's shown samples in ``bins`` bins."""
    flat = canvas.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    if bins <= 64 and not bins & (bins - 1):  # places of all three fit a byte
        place = (flat[:, :3] >> np.uint8(9 - bins.bit_length())) + np.arange(0, 3 * bins, bins, dtype=np.uint8)
        return np.bincount(place.ravel(), minlength=3 * bins).reshape(3, bins)
    place = flat[:, :3].astype(np.int64) * bins >> 8
    return np.bincount((place + np.arange(3) * bins).ravel(), minlength=3 * bins).reshape(3, bins)


_FRAME = "id long, frame int, at_ms long, delay_ms int, disposal int, width int, height int, rgba binary, hist_red array<int>, hist_green array<int>, hist_blue array<int>, error string"


def decode_frames(rows: DataFrame, id_col: str = "id", media_col: str = "media", bins: int = 16, most: int = MOST_SAMPLES) -> DataFrame:
    """One row per shown frame, with the canvas (rows of RGBA) and histograms of its shown samples in ``bins`` bins.

    A GIF whose canvas or frame has more than ``most`` samples is refused with an error row.
    """
    ship(rows.sparkSession)
    if not 1 <= bins <= 256:
        raise ValueError("bins must be 1 to 256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(*values: object) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.string())
            names = [x.split()[0] for x in _FRAME.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    yield row(i, *[None] * 10, "no media")
                    continue
                try:
                    for f in frames(data.as_py(), most):
                        hist = histograms(f.canvas, bins).tolist()
                        yield row(i, f.number, f.at_ms, f.delay_ms, f.disposal, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), *hist, None)
                except ValueError as e:
                    yield row(i, *[None] * 10, str(e))

    return rows.select(column(id_col).cast("long").alias("id"), column(media_col).cast("binary").alias("media")).mapInArrow(run, _FRAME)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text in UTF-8, padded with zeros to a positive multiple of 64, as a GIF."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            some = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            media = [gif_of(t + bytes(-len(t) % WIDTH or (0 if t else WIDTH))) for t in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in some], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


_FRAMES = "at_ms: long, delay_ms: int, disposal: int, hist_red: array<int>, hist_green: array<int>, hist_blue: array<int>"
_FEATURES = f"id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, hist_grey array<long>, feature string, frames array<struct<{_FRAMES}>>"


def _equal_lists(values: np.ndarray, size: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size), pa.int32()), pa.array(values, pa.int32()))


def read_payload(media: DataFrame, bins: int = 16) -> DataFrame:
    """What the stored bytes of ``store`` hold when read back: digests, a histogram of samples, a feature, and the timed frames.

    ``frames`` has each frame's time and colour histograms as shown, in ``bins`` bins, a divisor of 256.
    """
    ship(media.sparkSession)
    if bins < 1 or 256 % bins:
        raise ValueError("bins must divide 256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            out: list[list] = [[] for _ in range(8)]
            told, seen = [], []
            for data in batch.column(2).to_pylist():
                sha, size, tail, hist, n = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0
                for n, f in enumerate(frames(data), 1):  # noqa: B007
                    piece = payload_of(f)
                    sha.update(piece)
                    size += len(piece)
                    tail = piece[-WIDTH:]
                    hist += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
                    told.append((f.at_ms, f.delay_ms, f.disposal))
                    seen.append(histograms(f.canvas, bins))
                grey = np.add.reduceat(hist, np.arange(0, 256, 256 // bins))
                level = float(hist @ np.arange(256)) / size
                share = np.round(grey / size * 255).astype(np.uint8)
                for values, value in zip(out, (size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), n, grey.tolist(), f"{level:.3f}:{share.tobytes().hex()}"), strict=True):
                    values.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.string())
            colours = np.array(seen, np.int64).reshape(-1, 3, bins)
            at, delay, disposal = np.array(told, np.int64).reshape(-1, 3).T
            fields = [pa.array(at), pa.array(delay, pa.int32()), pa.array(disposal, pa.int32()), *[_equal_lists(colours[:, c].ravel(), bins) for c in range(3)]]
            rows = pa.StructArray.from_arrays(fields, [x.split(":")[0] for x in _FRAMES.split(", ")])
            shown = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(out[5]))), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)], shown], _NAMES)

    return media.select("id", "n_bytes", "media").mapInArrow(run, _FEATURES)


_NAMES = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "hist_grey", "feature", "frames"]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a GIF in a table of the shared folder and reads that table back."""
    return read_payload(staged(store(docs, id_col, text_col), "gif"))
