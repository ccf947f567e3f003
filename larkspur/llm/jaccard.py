"""Near duplicates by the Jaccard similarity of word n-grams, joined on rare prefixes.

A document's set holds its distinct runs of ``size`` lower-cased words, as 64-bit hashes. Two
documents link when ``percent`` * union <= 100 * intersection. Equal sets meet by a digest first,
so copies are one set from then on, whatever their number.

Order: an n-gram that one document holds never matches and comes first, then others by the
number of documents, rarest first, then by hash. Sets that are similar enough share one of their
first ``n - ceil(percent * n / 100) + 1`` n-grams, and only those are joined.

Counting goes by blocks of documents. A block sends its n-grams, sorted and packed as differences,
to the ranges of their hashes, and gets those back that other documents hold too, with the class
of their count. N-grams of many documents (``HEAVY``, told by counters of fixed size in a first
pass) come last in the order, stay in their block and load no range.

Join: the prefix n-grams are rows with the length and what the filters need. Rows of an n-gram
meet in one task, in groups of at most ``GROUP``; those of a more frequent one are salted into
several groups. A pair must pass the length filter, the positional filter (what can follow the
common n-gram) and the suffix filter: the n-grams that no other document holds, and the parity
bits in which two 512-bit signatures differ, bound the difference of the sets from below.

Components: first, pairs within a group, of a large group only a spanning forest of what passed
the filters. Each is verified once, on the whole sets. Then the groups of frequent n-grams meet
once more, across salts, for all pairs of different components that pass the filters and were not
verified. So every link between different components is found, while a group of near copies does
not emit all of its pairs.

Defined results: a text without words, or null, has an empty set and is linked with nothing; its
component is its own id. Rows of one id are documents of their own; a null id takes part but names
no component unless all ids there are null. Empty tables give empty results; extra columns are
ignored. A very long text is a slice of its own.

Cost: about 6 bytes an n-gram are shuffled for the counts, and of those that several documents
hold about 8 bytes come back. The filters compare all pairs of a frequent n-gram's groups, one
group against one at a time: time, not rows, grows with the square of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import column, ship, staged
from larkspur.llm.simhash import components
from larkspur.llm.words import SPACED, mixed, shingles, word_slices

#: Documents a block, and n-grams a range, in expectation.
BLOCK, RANGE = 256, 250_000
#: Counters of the first pass, and the share of documents above which an n-gram is heavy.
COUNTERS, HEAVY = 1 << 20, 500
#: Rows of a group, and of a group that is small enough to emit all its pairs.
GROUP, SMALL = 512, 32
#: Rows of a table of frequent n-grams that may be sent to every task.
MOST_SENT = 200_000
_SLICE = 2 << 20
_BITS = 512


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of (id, text) with the sorted set of each text."""
    for batch, w in word_slices(batches, 1, SPACED, _SLICE):
        h, row = shingles(w, size)
        at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
        yield batch, [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def _documents(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, key, bucket, c): a row a document, and counters: documents (bucket -1), n-grams (-2) and those of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, total = np.zeros(COUNTERS, np.int32), 0, 0
        for batch, sets in _sets(batches, size):
            n = np.array([len(s) for s in sets], np.int64)
            np.add.at(counts, _counter(np.concatenate(sets)), 1)
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), none, none], ["id", "n", "key", "bucket", "c"])
        # Counters that are low here say nothing of a heavy n-gram; the classes need not be exact, only the same everywhere.
        at = np.flatnonzero(counts >= max(8, 3 * docs // (4 * HEAVY)))
        more = len(at) + 2
        bucket, c = np.concatenate((at, [-1, -2])), np.concatenate((counts[at].astype(np.int64), [docs, total]))
        yield pa.RecordBatch.from_arrays([pa.nulls(more, pa.int64()), pa.nulls(more, pa.int64()), pa.nulls(more, pa.binary()), pa.array(bucket), pa.array(c)], ["id", "n", "key", "bucket", "c"])

    return rows.mapInArrow(run, "id long, n long, key binary, bucket long, c long")


def packed(tokens: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their differences, byte plane by byte plane."""
    if not len(tokens):
        return b""
    gaps = np.diff(tokens, prepend=np.uint64(0))
    width = max(1, (int(gaps[1:].max() if len(gaps) > 1 else 0).bit_length() + 7) // 8)
    planes = gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + tokens[:1].tobytes() + planes.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    n = (len(data) - 9) // width
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(width, n).T
    return np.cumsum(np.concatenate((np.frombuffer(data, np.uint64, 1, 1), gaps.reshape(-1).view(np.uint64))), dtype=np.uint64)


def _classes(counts: np.ndarray) -> np.ndarray:
    """The class of a count in one byte: itself up to 100, then by its logarithm, below that of heavy n-grams."""
    return np.where(counts <= 100, counts, np.minimum(254, 100 + 8 * np.log2(np.maximum(counts, 100) / 100)).astype(np.int64)).astype(np.uint8)


_BLOCKS = "part long, block long, kind int, a binary, b binary, c binary"


def _blocks(rows: DataFrame, size: int, parts: int, heavy: bytes) -> DataFrame:
    """Blocks cut by the ranges of their n-grams (kind 0: n-grams, documents), and a row of each block (1: sizes, digests; 2: heavy n-grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(heavy, np.uint8), bitorder="little").astype(bool)
        held: list[np.ndarray] = []
        number, task = 0, 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            sizes = np.array([len(s) for s in held], np.uint32)
            tokens, own = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint8), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, own = tokens[order], own[order]
            # The block's name: the same whenever the task runs again, and another for each block.
            name = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=number) ^ xxhash.xxh3_64_intdigest(str(task).encode())
            number += 1
            often = bits[_counter(tokens)]
            light, of = tokens[~often], own[~often]
            part = _range(light, parts)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(cuts[1:], len(part)) if len(cuts) else cuts
            block_id = name - 2**64 if name >= 2**63 else name
            out = [(int(part[i]), 0, packed(light[i:j]), of[i:j].tobytes(), b"") for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]
            out.append((name % parts, 1, sizes.tobytes(), b"".join(_digest(s) for s in held), b""))
            out.append((name % parts, 2, packed(tokens[often]), own[often].tobytes(), b"\xff" * int(often.sum())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([block_id] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.int32()), *[pa.array([o[k] for o in out], pa.binary()) for k in (2, 3, 4)]],
                ["part", "block", "kind", "a", "b", "c"],
            )
            held.clear()

        for batch, sets in _sets(batches, size):
            if not number and not held:
                task = int(np.asarray(batch.column(2))[0])
            for s in sets:
                if len(s):
                    held.append(s)
                    if len(held) == BLOCK:
                        yield from block()
        if held:
            yield from block()

    return rows.mapInArrow(run, _BLOCKS)


def _range(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)).astype(np.int64) * parts) >> 32


def _shared(table: pa.Table) -> pa.Table:
    """One range of all blocks: of each block the n-grams that more than one document holds, with the class of their count."""
    kind, a, b, c, block = (table.column(x).to_pylist() for x in ("kind", "a", "b", "c", "block"))
    light = [i for i, k in enumerate(kind) if k == 0]
    out = [(block[i], kind[i], a[i], b[i], c[i]) for i, k in enumerate(kind) if k]
    if light:
        lists = [unpacked(a[i]) for i in light]
        sizes = np.array([len(x) for x in lists])
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        group = np.cumsum(first) - 1
        n = np.empty(len(every), np.int64)
        n[order] = np.diff(np.append(np.flatnonzero(first), len(every)))[group]
        at = np.concatenate(([0], np.cumsum(sizes)))
        for x, (i, low, high) in enumerate(zip(light, at[:-1].tolist(), at[1:].tolist(), strict=True)):
            keep = n[low:high] > 1
            if keep.any():
                out.append((block[i], 0, packed(lists[x][keep]), np.frombuffer(b[i], np.uint8)[keep].tobytes(), _classes(n[low:high][keep]).tobytes()))
    return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "kind": pa.array([o[1] for o in out], pa.int32()), **{x: pa.array([o[k] for o in out], pa.binary()) for k, x in ((2, "a"), (3, "b"), (4, "c"))}})


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least size of a set that a set of n can be similar to, which is also their least overlap."""
    return -(-n * percent // 100)


def signature(tokens: np.ndarray) -> bytes:
    """512 bits: of how many n-grams each bit is hit, modulo 2. Sets differ in at least as many n-grams as their bits do."""
    return np.packbits(np.bincount((mixed(tokens) >> np.uint64(55)).astype(np.int64), minlength=_BITS) & 1, bitorder="little").tobytes()


def _block_sets(percent: int):
    """A group function: the sets of one block that can be similar to another, n-grams in the order of the join."""

    def run(table: pa.Table) -> pa.Table:
        kind, a, b, c = (table.column(x).to_pylist() for x in ("kind", "a", "b", "c"))
        head = kind.index(1)
        n, digests = np.frombuffer(a[head], np.uint32).astype(np.int64), b[head]
        rest = [i for i, k in enumerate(kind) if k != 1]
        tokens = np.concatenate([unpacked(a[i]) for i in rest] or [np.zeros(0, np.uint64)])
        own = np.frombuffer(b"".join(b[i] for i in rest), np.uint8)
        rank = np.frombuffer(b"".join(c[i] for i in rest), np.uint8)
        order = np.lexsort((tokens, rank, own))
        tokens, own = tokens[order], own[order]
        at = np.searchsorted(own, np.arange(len(n) + 1))
        seen, out = set(), []
        for d in np.flatnonzero((np.diff(at) >= _needed(n, percent)) & (n * 100 // percent > _needed(n, percent))).tolist():
            key, s = digests[16 * d : 16 * d + 16], tokens[at[d] : at[d + 1]]
            if key not in seen:
                seen.add(key)
                out.append((key, int(n[d]), int(n[d]) - len(s), s.view(np.int64), signature(s)))
        ends = np.cumsum([0, *[len(o[3]) for o in out]], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o[3] for o in out] or [np.zeros(0, np.int64)])))
        return pa.table({"key": pa.array([o[0] for o in out], pa.binary()), "n": pa.array([o[1] for o in out], pa.int64()), "alone": pa.array([o[2] for o in out], pa.int64()), "tokens": lists, "bits": pa.array([o[4] for o in out], pa.binary())})

    return run


def _candidates(rows: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """(a, b) of the rows of each group (token, lot) that pass the filters; without ``all_pairs`` a forest of large groups.

    ``rows``: token, lot, salt, key, n, pos, alone, bits, root. Rows of equal roots are known to be of
    one component. A row whose salt is another than the lot is a visitor, and visitors don't meet.
    """
    order = ["token", "lot"]

    def survivors(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows those that pass, and the bound of their difference."""
        n, m = rows["n"][x], rows["n"][y]
        ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (rows["key"][x] != rows["key"][y]) & (rows["root"][x] != rows["root"][y])
        ok &= (rows["salt"][x] == rows["lot"][x]) | (rows["salt"][y] == rows["lot"][y])
        need = -(-percent * (n + m) // (100 + percent))
        ok &= np.minimum(n - rows["pos"][x], m - rows["pos"][y]) >= need
        ok = np.flatnonzero(ok)
        x, y = x[ok], y[ok]
        apart = rows["alone"][x] + rows["alone"][y] + np.bitwise_count(rows["bits"][x] ^ rows["bits"][y]).sum(1, dtype=np.int64)
        near = apart <= (n + m)[ok] - 2 * need[ok]
        return ok[near], apart[near]

    def forest(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Of the pairs in order of nearness those that connect what was not connected."""
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        keep = []
        for k in np.argsort(apart, kind="stable").tolist():
            p, q = top(int(x[k])), top(int(y[k]))
            if p != q:
                parent[p] = q
                keep.append(k)
        return np.array(keep, int)

    def met(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate(([True], (np.diff(rows["token"]) != 0) | (np.diff(rows["lot"]) != 0)))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        xs, ys = [], []
        for m in range(2, SMALL + 1):  # groups of one size together
            here = starts[sizes == m]
            if len(here):
                p, q = np.triu_indices(m, 1)
                for lot in np.array_split(here, -(-len(here) * len(p) // 200_000)):
                    x, y = (lot[:, None] + p).ravel(), (lot[:, None] + q).ravel()
                    ok, _ = survivors(rows, x, y)
                    xs.append(x[ok])
                    ys.append(y[ok])
        for start, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            p, q = np.triu_indices(m, 1)
            ok, apart = survivors(rows, start + p, start + q)
            x, y = start + p[ok], start + q[ok]
            if not all_pairs:
                keep = forest(x, y, apart)
                x, y = x[keep], y[keep]
            xs.append(x)
            ys.append(y)
        return np.concatenate(xs or [np.zeros(0, int)]), np.concatenate(ys or [np.zeros(0, int)])

    def told(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(kept)
        columns = {x: np.asarray(table.column(x)).astype(np.int64) for x in ("token", "lot", "salt", "n", "pos", "alone")}
        columns["bits"] = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, _BITS // 64)
        for x in ("key", "root"):  # half of a digest tells two sets of a group apart
            columns[x] = np.frombuffer(b"".join(table.column(x).to_pylist()), np.uint64)[::2]
        x, y = met(columns)
        key = table.column("key").combine_chunks()
        key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
        return pa.RecordBatch.from_arrays([key.take(pa.array(x)), key.take(pa.array(y))], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(2)])
            other = np.flatnonzero((group != group[:, -1:]).any(0))
            if len(other) == 0:
                kept.append(batch)
                continue
            last = int(other[-1]) + 1
            yield told([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        if kept:
            yield told(kept)

    found = rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "x binary, y binary")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``linked``, by their whole sets: n-grams that one document holds can't be common."""
    sides = [sets.select(F.col("key").alias(x), F.col("tokens").alias(f"t{x}"), F.col("n").alias(f"n{x}")) for x in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return met.select("a", "b", (100 * common >= percent * (F.col("na") + F.col("nb") - common)).alias("linked"))


def classes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: the documents (id, n, key), and (key, root) of the sets that are linked with another set."""
    ship(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    told = staged(_documents(rows.select("id", "text"), size), "jaccard-documents")
    counters = told.where("bucket is not null").groupBy("bucket").agg(F.sum("c").alias("c"))
    counters = staged(counters, "jaccard-counters")
    whole = {r["bucket"]: r["c"] for r in counters.where("bucket < 0").collect()}  # two rows
    least = max(64, whole.get(-1, 0) // HEAVY)
    heavy = np.zeros(COUNTERS, bool)
    heavy[[r["bucket"] for r in counters.where((F.col("bucket") >= 0) & (F.col("c") >= least)).select("bucket").collect()]] = True  # at most COUNTERS
    parts = max(1, -(-whole.get(-2, 0) // RANGE))
    found = _blocks(rows, size, parts, np.packbits(heavy, bitorder="little").tobytes())
    shared = found.groupBy("part").applyInArrow(_shared, "block long, kind int, a binary, b binary, c binary")
    sets = shared.groupBy("block").applyInArrow(_block_sets(percent), "key binary, n long, alone long, tokens array<long>, bits binary")
    sets = staged(sets.dropDuplicates(["key"]), "jaccard-sets")

    take = F.col("n") - F.call_function("div", percent * F.col("n") + 99, F.lit(100).cast("long")) + 1 - F.col("alone")
    entries = sets.where(take > 0).select("key", "n", "alone", "bits", F.posexplode(F.slice("tokens", 1, take.cast("int"))).alias("at", "token"))
    entries = entries.select("token", "key", "n", "alone", "bits", (F.col("at") + F.col("alone")).alias("pos"))
    often = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SMALL)
    often = staged(often.select("token", F.ceil(F.col("c") / GROUP).cast("int").alias("salts")), "jaccard-often")
    sent = F.broadcast(often) if often.limit(MOST_SENT + 1).count() <= MOST_SENT else often
    salt = F.coalesce(F.pmod(F.xxhash64("token", "key"), F.col("salts")), F.lit(0)).cast("int")
    salted = entries.join(sent, "token", "left").withColumn("salt", salt)
    first = _candidates(salted.select("token", F.col("salt").alias("lot"), "salt", "key", "n", "pos", "alone", "bits", F.col("key").alias("root")), percent, False)
    tried = staged(_verified(staged(first, "jaccard-pairs"), sets, percent), "jaccard-tried")
    return told.where("bucket is null").select("id", "n", "key"), _across(salted, sets, tried, percent)


def _named(links: DataFrame) -> DataFrame:
    """(key, root) of every end of a link."""
    found = components(links)
    return staged(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "key"), "jaccard-roots")


def _across(salted: DataFrame, sets: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """(key, root) after the groups of frequent n-grams have met across salts and components.

    Rows of an n-gram's commonest root stay in the lot of their salt; all others visit every lot.
    """
    sure = tried.where("linked").select("a", "b")
    roots = _named(sure)
    often = staged(salted.where("salts is not null").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "jaccard-frequent")
    sizes = often.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    mixed_rows = often.join(sizes.where("roots > 1"), "token")
    lots = F.when(F.col("root") == F.col("main"), F.array("salt")).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    rows = mixed_rows.select("token", F.explode(lots).alias("lot"), "salt", "key", "n", "pos", "alone", "bits", "root")
    more = _candidates(rows, percent, True).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    links = staged(_verified(staged(more, "jaccard-more"), sets, percent).where("linked").select("a", "b"), "jaccard-links")
    return roots if links.isEmpty() else _named(links.unionByName(sure))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id, the smallest id that links reach, itself included."""
    if size < 1 or not 50 <= percent <= 100:
        raise ValueError("size must be positive and percent between 50 and 100")
    documents, roots = classes(docs, id_col, text_col, size, percent)
    firsts = documents.where("key is not null").groupBy("key").agg(F.min("id").alias("first"))
    of = firsts.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = of.groupBy("root").agg(F.min("first").alias("name"))
    named = staged(of.join(names, "root").select("key", F.col("name").alias("component_id")), "jaccard-named")
    empty = documents.where("key is null").withColumn("component_id", F.col("id"))
    out = documents.where("key is not null").join(named, "key").select("id", "n", "component_id").unionByName(empty.select("id", "n", "component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
