"""Token ids in directly addressable codes.

A segment is one binary value that holds whole documents. Ids are split into chunks of
``CHUNK_BITS`` bits. Level 0 has the lowest chunk of every id; a level's continuation bitmap says
which of its ids go on to the next level, and the next level holds the next chunk of just
those. A rank directory, the number of set bits before each block of ``RANK_BLOCK`` bits, turns
a position in a level into the position in the next, so any id is read with one step a level
and without decoding what stands before it.

Layout of a segment, little-endian:

    8 bytes  "LSDAC001"
    u64      documents, u64 ids, u64 levels, u64 base (ids of the part before this segment)
    i64[documents]      document ids (the smallest long stands for null)
    u64[documents + 1]  first id of each document within the segment, and the end
    per level: u64 entries, u8[entries] chunks, u64[ceil(entries / 64)] bitmap,
               u32[ceil(entries / 512)] rank directory

Segments are rows of a Parquet table in the given folder, written by Spark's own committer, so
a lost executor's task leaves nothing behind and any store that Spark reaches will do. Parts are
ranges of doc_id in ascending order; a part's segments are numbered. Only one number a part, its
count of ids, is summed globally, and the parts are as many as shuffle partitions.

Defined results: a null or empty text has the end id only; repeated ids are separate documents
in the order of their texts; a null id comes first; an empty table gives no segment; extra
columns are ignored, whatever their names. A very long text is encoded whole, in memory linear in
its length; batches are encoded in slices.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import column, ship, sliced, utf8

MAGIC = b"LSDAC001"
CHUNK_BITS = 8
RANK_BLOCK = 512
#: A segment is closed once it has this many ids.
SEGMENT_IDS = 1 << 20
#: Bytes of encoded words a worker keeps before it starts afresh, and the longest word it keeps.
CACHE_BYTES, CACHE_LONGEST = 64 << 20, 64
#: What a table's entry takes besides the word's characters and ids.
_ENTRY = 190
#: Text bytes that are encoded at a time.
_SLICE = 8 << 20
NULL_ID = -(2**63)


class Segment:
    """Reads one segment; ``buffer`` is not copied."""

    def __init__(self, buffer: bytes) -> None:
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("no token segment")
        self.n_docs, self.n_ids, levels, self.base = (int(x) for x in np.frombuffer(buffer, "<u8", 4, 8))
        at = 40
        self.doc_ids = np.frombuffer(buffer, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(buffer, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(buffer, "<u8", 1, at)[0])
            words, blocks = -(-n // 64), -(-n // RANK_BLOCK)
            chunks = np.frombuffer(buffer, np.uint8, n, at + 8)
            bits = np.frombuffer(buffer, np.uint8, 8 * words, at + 8 + n)
            ranks = np.frombuffer(buffer, "<u4", blocks, at + 8 + n + 8 * words)
            at += 8 + n + 8 * words + 4 * blocks
            self.levels.append((chunks, bits, ranks))

    def access(self, i: int) -> int:
        """The id at position i, touching one chunk and one rank block a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (CHUNK_BITS * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            before = bits[block * RANK_BLOCK >> 3 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, at = np.zeros(self.n_ids, "<u4"), np.arange(self.n_ids)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype("<u4") << np.uint32(CHUNK_BITS * level)
            at = at[np.unpackbits(bits, bitorder="little", count=len(chunks)).view(bool)]
        return out


def pack(doc_ids: list[int | None], parts: list[bytes], base: int = 0) -> bytes:
    """One segment of documents whose ids are little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    starts = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype("<u8")
    out = []
    rest, levels = ids, 0
    while len(rest):
        more = rest >> np.uint32(CHUNK_BITS) > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % 8, np.uint8)))
        padded = np.concatenate((more, np.zeros(-len(more) % RANK_BLOCK, bool))).reshape(-1, RANK_BLOCK).sum(1)
        ranks = (np.cumsum(padded) - padded).astype("<u4")
        out += [len(rest).to_bytes(8, "little"), rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest, levels = (rest >> np.uint32(CHUNK_BITS))[more], levels + 1
    head = np.array([len(parts), len(ids), levels, base], "<u8").tobytes()
    named = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    return b"".join((MAGIC, head, named, starts.tobytes(), *out))


def _lower_and_blank(spec: dict) -> bool:
    """Whether a tokenizer's file says that white space is dropped and letters are made lower case, and no more."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    normal = [x["type"] for x in normal.get("normalizers", [])]
    pre = [(x["type"], x.get("behavior"), x.get("invert"), x.get("add_prefix_space")) for x in pre.get("pretokenizers", [])]
    return normal == ["NFC", "Replace", "Lowercase"] and pre == [("Split", "Removed", True, None), ("ByteLevel", None, None, False)] and not any(set(x["content"]) & set(" \t\n\x0b\x0c\r") for x in spec["added_tokens"])


class WordEncoder:
    """The tokenizers library over the distinct words of a batch.

    A tokenizer that drops white space never puts ASCII white space inside a token, so a text's
    ids are those of its words one after another. A batch's words are numbered by Arrow's
    dictionary encoding, the library encodes the distinct ones that a bounded table doesn't
    hold, and the ids are gathered by number. Where a word is an ASCII or Latin-1 letter followed
    by marks of ``TAIL`` up to its end, the pre-tokenizer cuts between them and stem and tail are
    looked up apart. The library gets many words at a time, set apart by a character that they
    don't hold. With a tokenizer of another kind whole texts go to the library.
    """

    TAIL = ".,!?;:*#$%&"
    APART = "\x01"
    TOGETHER = 2000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_words = _lower_and_blank(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        apart = self.tokenizer.encode(self.APART, add_special_tokens=False).ids
        self.apart = apart[0] if len(apart) == 1 else None

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if self.apart is not None and self.APART not in w]
        some = [plain[i : i + self.TOGETHER] for i in range(0, len(plain), self.TOGETHER)]
        lines = [f" {self.APART} ".join(x) for x in some]
        for x, e in zip(some, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            body, at = ids.tobytes(), 0
            ends = [*np.flatnonzero(ids == self.apart).tolist(), len(ids)]
            for w, end in zip(x, ends, strict=True):
                out[w] = body[4 * at : 4 * end]
                at = end + 1
        for w in words if self.apart is None else [w for w in words if self.APART in w]:
            out[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _keep(self, fresh: dict[str, bytes]) -> None:
        for w, ids in fresh.items():
            if len(w) <= CACHE_LONGEST:
                self.known_bytes += _ENTRY + len(w) + len(ids)
                if self.known_bytes > CACHE_BYTES:
                    self.known, self.known_bytes = {}, _ENTRY + len(w) + len(ids)
                self.known[w] = ids

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, "<u4"), *got]), np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int64)

    def _parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Stem and tail of each word, the stem's ASCII letters lower-cased as the tokenizer does."""
        marked = pc.match_substring(words, "<|")  # may hold an added token, which is as it is written
        low = pc.if_else(marked, words, pc.ascii_lower(words))
        stem = pc.ascii_rtrim(low, characters=self.TAIL)
        body, at = utf8(stem)
        size, body = np.diff(at), np.concatenate((np.zeros(2, np.uint8), body))
        last, before = body[at[1:] + 1], body[at[1:]]
        letter = (last - np.uint8(97) < 26) & (size > 0)
        letter |= (size > 1) & (before == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
        cut = pc.and_(pa.array(letter), pc.invert(marked))
        tail = pc.struct_field(pc.extract_regex(low, r"(?P<t>[.,!?;:*#$%&]*)$"), "t")
        return pc.if_else(cut, stem, low), pc.if_else(cut, tail, "")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        if not self.by_words:
            return self._whole(texts)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        of_text = np.asarray(lists.offsets).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        stem, tail = self._parts(words.dictionary)
        parts = pa.concat_arrays([stem, tail]).dictionary_encode()
        distinct, known = parts.dictionary.to_pylist(), self.known
        fresh = self._encoded([w for w in distinct if w not in known])
        ids = [fresh[w] if w in fresh else known[w] for w in distinct]
        self._keep(fresh)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), "<u4")
        both = np.asarray(parts.indices).reshape(2, -1)[:, np.asarray(words.indices)].T.ravel()  # stem, tail, stem, tail, ...
        n = size[both]
        end = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(first[both] - end[:-1], n) + np.arange(end[-1])]
        return out, end[2 * (of_text - of_text[0])]


_LOADED: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts and writes their segments in ascending id order to ``folder``."""
    ship(docs.sparkSession)
    path = path or default_path()
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, number, base = loaded(path), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            whole = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
            columns = [[part], [number], [len(ids)], [held], [pack(ids, whole, base)]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "number", "n_docs", "n_ids", "data"])

        for batch in sliced(batches, 1, _SLICE):
            got, ends = words.encode(batch.column(1))
            body = memoryview(got).cast("B")
            for i, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids.append(i)
                parts += (body[4 * a : 4 * b], end)
                held += b - a + 1
                if held >= SEGMENT_IDS:
                    yield close()
                    number, base, ids, parts, held = number + 1, base + held, [], [], 0
        if ids:
            yield close()

    rows.mapInArrow(run, "part int, number int, n_docs long, n_ids long, data binary").write.parquet(folder)


def _with_base(segments: DataFrame) -> DataFrame:
    """``segments`` with the number of ids in all parts before theirs."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a shuffle partition
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    return segments.join(F.broadcast(bases), "part")  # as many rows as the writer had shuffle partitions


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(data.as_buffer())
                body, at = memoryview(s.ids()).cast("B"), s.starts
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [
                    pa.array([None if d == NULL_ID else d for d in s.doc_ids.tolist()], pa.int64()),
                    pa.array(at[:-1] + (base + s.base)), pa.array(np.diff(at)), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _with_base(spark.read.parquet(folder)).select("part_base", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, positions: DataFrame, position_col: str = "position") -> DataFrame:
    """(position, id) of the distinct global positions that exist, read by random access.

    Positions meet segments on blocks of SEGMENT_IDS positions, which a segment overlaps few of.
    """
    ship(spark)
    rows = _with_base(spark.read.parquet(folder))
    order = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.select("part", "number", "n_ids", "part_base").withColumn("first", F.col("part_base") + F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / SEGMENT_IDS), F.floor((F.col("first") + F.col("n_ids") - 1) / SEGMENT_IDS))))
    asked = positions.select(column(position_col).cast("long").alias("position")).where("position >= 0").distinct().withColumn("block", F.floor(F.col("position") / SEGMENT_IDS))
    met = asked.join(spans, "block").where("position >= first and position < first + n_ids")
    wanted = met.groupBy("part", "number").agg(F.collect_list(F.struct("position", (F.col("position") - F.col("first")).alias("at"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(data.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([x["position"] for x in asked], pa.int64()), pa.array([s.access(x["at"]) for x in asked], pa.int64())], ["position", "id"])

    return rows.join(wanted, ["part", "number"]).select("asked", "data").mapInArrow(run, "position long, id long")
