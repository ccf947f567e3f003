"""Phrase collocations by contiguous pattern growth in the manner of PrefixSpan.

Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends, and pieces into
words at blanks and tabs. A phrase is a run of 2 to 4 words of one piece, counted with overlaps,
for each language apart.

1. Words are counted, in whole slices first. Those with ``least`` occurrences are the frequent
   prefixes of length one.
2. Neighbouring frequent words are counted alike. A phrase with ``least`` occurrences holds only
   frequent neighbours, so an occurrence is cut where the next neighbours are not frequent.
3. Each occurrence that begins with frequent neighbours is projected: what follows it, up to four
   words, goes to the task of its prefix. A slice's equal projections travel as one row.
4. Each prefix's rows, in order, are grown to the right depth-first; a prefix below ``least`` is
   not grown. All of a prefix is in one task, and many prefixes share a task.

A prefix is a word. A word with ``split`` occurrences is split into its pairs, and a pair with as
many into its triples, whose rows spread over tasks; the pair's own count then comes from sums
made in the slices. So no task holds all of a hot word, and a triple's rows are its different
fourth words, once a slice.

Which words and pairs are frequent or hot is told to the workers by bitmaps over hashes, whose
sizes are fixed (``WORD_BITS``, ``PAIR_BITS``, ``HOT_BITS``). Where two share a bit, more is
shipped or split than needed, and the counts, which are exact, decide. Words are told apart by
64-bit hashes of language and word.

Scores, cuts and the phrases that longer ones cover are joins over the frequent phrases alone;
products that can pass 64 bits are decimals. The ranking numbers stored ranges.

Defined results: a null text is empty, a null language ``und``; repeated rows count again; empty
tables give no rows; extra columns are ignored. A very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import column, ship, staged
from larkspur.llm.words import BLANKED, STOPS, Words, mixed, word_slices
from larkspur.operators.ranges import numbered

MOST_WORDS = 4
#: Languages whose totals may be sent to every task.
MOST_LANGS = 10_000
WORD_BITS, PAIR_BITS, HOT_BITS = 26, 27, 22
_SLICE = 1 << 19
#: Words that a worker gathers before it sends their counts, and rows that it sends at a time.
_GATHER, _ROWS = 400_000, 50_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _held(bitmap: bytes, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = _bit(hashes, bits)
    return (np.frombuffer(bitmap, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame, bits: int, name: str = "h") -> bytes:
    """A bitmap of 2^bits bits with those that the leading bits of the hashes name: at most 2^bits / 8 bytes reach the driver."""
    at = F.shiftrightunsigned(F.col(name), 64 - bits) + 1
    parts = hashes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = bytearray(1 << (bits - 3))
    for r in parts:
        chunk = bytes(r["m"])[: len(out)]
        start = (r["b"] - 1) * 4096
        out[start : start + len(chunk)] = chunk[: len(out) - start]
    return bytes(out)


def _told(w: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of language and word, whether the next word stands in the same piece) of each word."""
    h = mixed(w.hashes ^ keys.view(np.uint64)[w.row])
    stops = np.concatenate(([0], np.cumsum(STOPS[w.text])))
    near = np.zeros(len(h), bool)
    near[:-1] = (w.row[1:] == w.row[:-1]) & (stops[w.starts[1:]] == stops[w.ends[:-1]])
    return h, near


def _pair(h: np.ndarray, near: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    out[:-1] = mixed(h[:-1] * _FACTOR + h[1:])
    out[~near] = 0
    return out


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, where each is first, its sum) of several arrays of keys with counts."""
    every, counts = np.concatenate(keys), np.concatenate(n)
    key, first, back = np.unique(every, return_index=True, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, counts)
    return key, first, total


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, _ROWS):
        yield batch.slice(at, _ROWS)


def _word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, h, word, f) of the words with ``least`` occurrences; the row without a word has the language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, said, langs, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            key, first, total = _summed(keys, counts)
            first = pa.array(first)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(langs).take(first), pa.array(key.view(np.int64)), pa.concat_arrays(said).take(first), pa.array(total)], ["lang", "h", "word", "f"])

        for batch, w in word_slices(batches, 2, BLANKED, _SLICE):
            lang = batch.column(0).cast(pa.string())
            own = np.asarray(batch.column(1)).astype(np.int64)
            h, _ = _told(w, own)
            key, first, n = np.unique(h, return_index=True, return_counts=True)
            per, at, back = np.unique(own, return_index=True, return_inverse=True)
            sums = np.bincount(back, weights=w.counts(), minlength=len(per)).astype(np.int64)
            keys += [key, per.view(np.uint64)]
            counts += [n, sums]
            said += [pa.array(w.said(first), pa.string()), pa.nulls(len(per), pa.string())]
            langs += [lang.take(pa.array(w.row[first])), lang.take(pa.array(at))]
            held += len(key)
            if held > _GATHER // 2:
                yield from _cut(flush())
                keys, counts, said, langs, held = [], [], [], [], 0
        if keys:
            yield from _cut(flush())

    rows = docs.mapInArrow(run, "lang string, h long, word string, f long")
    return rows.groupBy("lang", "h", "word").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("word").isNull())


def _pair_counts(docs: DataFrame, frequent: bytes, least: int) -> DataFrame:
    """(h, f) of neighbouring frequent words with ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

        for batch, w in word_slices(batches, 2, BLANKED, _SLICE):
            h, near = _told(w, np.asarray(batch.column(1)).astype(np.int64))
            often = _held(frequent, h, WORD_BITS)
            near[:-1] &= often[:-1] & often[1:]
            found.append(_pair(h, near)[near])
            held += len(found[-1])
            if held > _GATHER:
                yield from _cut(flush())
                found, held = [], 0
        if found:
            yield from _cut(flush())

    return docs.mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


_CONTEXT = "key long, given int, h1 long, h2 long, h3 long, h4 long, n long"


def _projections(docs: DataFrame, pairs: bytes, hot_words: bytes, hot_pairs: bytes) -> DataFrame:
    """What follows each occurrence of frequent neighbours, under the hash of the prefix whose task grows it.

    ``given`` words of a row's phrases are counted by another row: those of a pair that is split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(found, axis=1)  # h1..h4, pair
            whole = mixed(mixed(mixed(rows[0] * _FACTOR + rows[1]) * _FACTOR + rows[2]) * _FACTOR + rows[3])
            _, first, n = np.unique(whole, return_index=True, return_counts=True)
            h, pair = rows[:4, first], rows[4, first]
            hot, split = _held(hot_words, h[0], HOT_BITS), _held(hot_pairs, pair, HOT_BITS)
            triple = mixed(pair * _FACTOR + h[2])
            key = np.where(split, triple, np.where(hot, pair, h[0]))
            given = np.where(split, 2, 0)
            more = split & (h[2] != 0)
            at, _, total = _summed([pair[split]], [n[split]])
            _, place = np.unique(pair, return_index=True)
            of = place[np.searchsorted(pair[place], at)] if len(at) else np.zeros(0, int)
            zero = np.zeros(len(at), np.uint64)
            keep = more | ~split
            columns = [np.concatenate((key[keep], at)), np.concatenate((given[keep], zero.astype(np.int64))), *[np.concatenate((h[k][keep], h[k][of] if k < 2 else zero)) for k in range(4)], np.concatenate((n[keep], total))]
            kinds = [np.int64, np.int32, np.int64, np.int64, np.int64, np.int64, np.int64]
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64).astype(t) if c.dtype == np.uint64 else c.astype(t)) for c, t in zip(columns, kinds, strict=True)], ["key", "given", "h1", "h2", "h3", "h4", "n"])

        for batch, w in word_slices(batches, 2, BLANKED, _SLICE):
            h, near = _told(w, np.asarray(batch.column(1)).astype(np.int64))
            pair = _pair(h, near)
            go = near & _held(pairs, pair, PAIR_BITS)
            ahead = [np.concatenate((h[k:], np.zeros(k, np.uint64))) if len(h) > k else np.zeros(len(h), np.uint64) for k in range(MOST_WORDS)]
            on = go.copy()
            for k in range(2, MOST_WORDS):
                step = np.zeros(len(h), bool)
                step[: max(len(h) - k + 1, 0)] = go[k - 1 :]
                on &= step
                ahead[k][~on] = 0
            found.append(np.stack([*[a[go] for a in ahead], pair[go]]))
            held += int(go.sum())
            if held > _GATHER // 2:
                yield from _cut(flush())
                found, held = [], 0
        if held:
            yield from _cut(flush())

    return docs.mapInArrow(run, _CONTEXT)


def grown(h: np.ndarray, n: np.ndarray, given: np.ndarray, least: int) -> list[tuple]:
    """(h1, h2, h3, h4, f) of the phrases with ``least`` occurrences among rows of sorted projections ``h`` (rows x 4) with counts."""
    sums = np.concatenate(([0], np.cumsum(n)))
    out: list[tuple] = []

    def grow(low: int, high: int, depth: int) -> None:
        # Rows low to high begin with the same ``depth`` words; their next words part them into runs.
        following = h[low:high, depth]
        cuts = np.flatnonzero(following[1:] != following[:-1]) + 1 + low
        starts, ends = np.concatenate(([low], cuts)), np.concatenate((cuts, [high]))
        f = sums[ends] - sums[starts]
        for at in np.flatnonzero((f >= least) & (h[starts, depth] != 0)).tolist():
            a, b = int(starts[at]), int(ends[at])
            if depth + 1 > max(1, given[a]):
                out.append((*h[a, : depth + 1].tolist(), *[0] * (MOST_WORDS - depth - 1), int(f[at])))
            if depth + 1 < MOST_WORDS:
                grow(a, b, depth + 1)

    if len(h):
        grow(0, len(h), 0)
    return out


def _grow_prefixes(projections: DataFrame, least: int) -> DataFrame:
    """(h1, h2, h3, h4, f): each prefix's rows stand together in one task and are grown there."""
    order = ["key", "given", "h1", "h2", "h3", "h4"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def told(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [rows.shape[1]]))
            found: list[tuple] = []
            every = np.ascontiguousarray(rows[2:6].T)
            heavy = np.add.reduceat(rows[6], starts) >= least
            for a, b in zip(starts[heavy].tolist(), ends[heavy].tolist(), strict=True):
                found += grown(every[a:b], rows[6, a:b], rows[1, a:b], least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(5)], ["h1", "h2", "h3", "h4", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            kept.append(rows)
            if rows[0, 0] == rows[0, -1] and rows[1, 0] == rows[1, -1]:
                continue  # may be all of one prefix, which goes on
            every = np.concatenate(kept, axis=1)
            last = int(np.flatnonzero((every[0] != every[0, -1]) | (every[1] != every[1, -1]))[-1]) + 1
            yield told(every[:, :last])
            kept = [every[:, last:]]
        if kept:
            yield told(np.concatenate(kept, axis=1))

    return projections.repartition("key").sortWithinPartitions(*order).mapInArrow(run, "h1 long, h2 long, h3 long, h4 long, f long")


_H = [f"h{i}" for i in range(1, MOST_WORDS + 1)]


def _phrase(*words: str) -> list[Column]:
    return [*map(F.col, words), *[F.lit(0).cast("long")] * (MOST_WORDS - len(words))]


def _part(a: int, b: int, more: dict[str, Column]) -> Column:
    """The words a to b of a phrase as a phrase, with other fields."""
    return F.struct(*[c.alias(x) for c, x in zip(_phrase(*_H[a:b]), _H, strict=True)], *[c.alias(n) for n, c in more.items()])


def frequent_phrases(docs: DataFrame, least: int, split: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: words (lang, h, word, f), and phrases (h1, h2, h3, h4, f) of 2 to 4 words."""
    ship(docs.sparkSession)
    words = staged(_word_counts(docs, least), "phrase-words")
    real = words.where("word is not null")
    pairs = staged(_pair_counts(docs, bitmap(real, WORD_BITS), least), "phrase-pairs")
    hot_words, hot_pairs = bitmap(real.where(F.col("f") >= split), HOT_BITS), bitmap(pairs.where(F.col("f") >= split), HOT_BITS)
    projections = _projections(docs, bitmap(pairs, PAIR_BITS), hot_words, hot_pairs)
    return words, staged(_grow_prefixes(projections, least), "phrase-grown")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, most: int = 2000, covered: int = 80, split: int = 20_000
) -> DataFrame:
    """Each language's first ``most`` phrases: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n the language's
    words; score is floor(2000000 a / (l + r)). A phrase goes where a longer one around it has
    ``covered`` percent of its occurrences.
    """
    if least < 1 or most < 1 or split < 1:
        raise ValueError("least, most and split must be positive")
    lang = F.coalesce(column(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("own"), column(text_col).cast("string").alias("text"))
    words, phrases = frequent_phrases(rows, least, split)
    size = sum(((F.col(x) != 0).cast("int") for x in _H[1:]), F.lit(1))
    counts = phrases.unionByName(words.where("word is not null").select(*[c.alias(x) for c, x in zip([F.col("h"), *[F.lit(0).cast("long")] * 3], _H, strict=True)], "f"))

    longer = phrases.withColumn("m", size).where("m > 2")
    inside = [_part(a, a + k, {"least": F.lit(a + k)}) for k in range(2, MOST_WORDS) for a in range(MOST_WORDS - k + 1)]
    # Of a phrase of m words, parts up to its end and shorter than it.
    parts = F.filter(F.array(*inside), lambda p: (p["least"] <= F.col("m")) & ~((p["h1"] == F.col("h1")) & (p["h2"] == F.col("h2")) & (p["h3"] == F.col("h3")) & (p["h4"] == F.col("h4"))))
    around = longer.select("f", F.explode(parts).alias("p")).groupBy(*[F.col(f"p.{x}").alias(x) for x in _H]).agg(F.max("f").alias("around"))
    kept = phrases.join(around, _H, "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("f"))).select(*_H, F.col("f").alias("a"))
    kept = staged(kept, "phrase-kept")

    cuts = []
    for m in range(2, MOST_WORDS + 1):
        cuts.append(F.array(*[F.struct(F.lit(k).alias("k"), _part(0, k, {}).alias("first"), _part(k, m, {}).alias("rest")) for k in range(1, m)]))
    cut = F.when(F.col("h3") == 0, cuts[0]).when(F.col("h4") == 0, cuts[1]).otherwise(cuts[2])
    met = kept.select(*_H, "a", F.explode(cut).alias("c"))
    for name, part in (("l", "first"), ("r", "rest")):
        side = counts.select(*[F.col(x).alias(f"{part}_{x}") for x in _H], F.col("f").alias(name))
        met = met.withColumns({f"{part}_{x}": F.col(f"c.{part}.{x}") for x in _H}).join(side, [f"{part}_{x}" for x in _H])
    both = F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(20,0)"), both)
    scored = met.withColumn("score", score).groupBy(*_H, "a").agg(F.min(F.struct("score", F.col("c.k").alias("k"), "l", "r")).alias("cut"))
    scored = scored.select(*_H, "a", "cut.l", "cut.r", "cut.score")

    spelled = scored.select("*", F.posexplode(F.filter(F.array(*_H), lambda x: x != 0)).alias("i", "h")).join(words.where("word is not null").select("lang", "h", "word"), "h")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    named = spelled.groupBy(*_H, "a", "l", "r", "score", "lang").agg(text.alias("phrase")).select("lang", "phrase", "a", "l", "r", "score")
    named = staged(named.withColumns({"__s": -F.col("score"), "__a": -F.col("a")}), "phrase-named")
    placed = numbered(named, ["lang", "__s", "__a", "phrase"])
    first = staged(placed, "phrase-placed")
    starts = first.groupBy("lang").agg(F.min("position").alias("__start"))
    totals = words.where("word is null").select("lang", F.col("f").alias("n")).join(starts, "lang")
    totals = staged(totals, "phrase-langs")
    if totals.limit(MOST_LANGS + 1).count() <= MOST_LANGS:
        totals = F.broadcast(totals)
    rank = (F.col("position") - F.col("__start") + 1).cast("int")
    return first.join(totals, "lang").withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
