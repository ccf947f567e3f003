"""SimHash near-duplicates by multi-index hashing.

Fingerprints: ASCII letters are lower-cased, words are runs of bytes other than ASCII white
space, each run of ``shingle`` words (repeats included) is hashed with XXH64 (seed 42) and a
bit is set when over half of the hashes set it. A text of fewer words is one shingle; a text
without words, or null, has fingerprint zero, which links like any other.

Search: the 64 bits are cut into four 16-bit segments. Table ``t`` holds every distinct
fingerprint under the 48 bits outside segment ``t``. Two fingerprints that differ in at most
two bits either differ inside one segment ``t`` only (same key in table ``t``), or in one bit
of segment ``t`` and one bit of a later segment ``s`` (same key in table ``t`` after one flip
in ``s``). So each fingerprint asks for its own key and for the radius-1 Hamming balls within
the later segments; a flip only sets bits, because the pair is met from its other side when
the bit has to be cleared. Matches are verified on the complete distance inside the join. A
key fixes 48 bits of distinct fingerprints, so a bucket can't exceed 65,536 of them however
many documents there are, and copies have met in one fingerprint before the search.

Components join fingerprints, not ids, so rows of one id whose texts differ each belong to the
component of their own text.

Defined results: repeated ids are separate rows, with equal results where their texts are equal;
a null id is kept and takes part like any other but never is a component's name unless all ids
there are null; an empty table gives an empty table; extra columns are ignored, and ``keep_one``
passes them through under any name. A very long text is hashed whole, in blocks of ``_BLOCK``
shingles; texts reach Python in slices of ``SLICE_BYTES``.

Cost: a fingerprint has four rows in the tables and asks for about 53 keys (a random one has half
of its bits clear), so 20 billion distinct fingerprints send about a trillion rows of 28 bytes
through one shuffle. Copies don't count: they have met in one fingerprint before.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import column, free_prefix, ship, sliced, staged

SEGMENTS = 4
RADIUS = 2
SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()  # bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)  # every bit of a single hash has the majority
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        a, b = starts[at : min(n, at + _BLOCK)].tolist(), ends[at + shingle - 1 : min(n, at + _BLOCK) + shingle - 1].tolist()
        h = np.fromiter((digest(line[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, more: Mapping[str, Column] | None = None) -> DataFrame:
    """(id, the columns ``more``, fp) of every row; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, batch_text):
            *kept, last = batch.columns
            fp = np.array([fingerprint(t or b"", shingle) for t in last.cast(pa.large_binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], [*batch.schema.names[:-1], "fp"])

    extra = [c.alias(name) for name, c in (more or {}).items()]
    batch_text = 1 + len(extra)
    rows = docs.select(column(id_col).cast("long").alias("id"), *extra, column(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _mask(segment: int) -> int:
    kept = ~(0xFFFF << (16 * segment)) & (2**64 - 1)
    return kept - 2**64 if kept >= 2**63 else kept


def _bit(b: int) -> int:
    return -(2**63) if b == 63 else 1 << b


def index_rows(fps: DataFrame) -> DataFrame:
    """The four tables in one: (t, key, fp, rep)."""
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("key")) for t in range(SEGMENTS)]
    return fps.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "fp", "rep")


def probe_rows(fps: DataFrame) -> DataFrame:
    """The keys each fingerprint asks for: (t, key, fp, rep)."""

    def table(t: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_mask(t)))
        keys = F.array(own)
        if t < SEGMENTS - 1:
            clear = F.filter(F.array(*[F.lit(_bit(b)) for b in range(16 * (t + 1), 64)]), lambda bit: F.col("fp").bitwiseAND(bit) == 0)
            keys = F.concat(keys, F.transform(clear, lambda bit: own.bitwiseOR(bit)))
        return F.transform(keys, lambda key: F.struct(F.lit(t).alias("t"), key.alias("key")))

    asked = F.concat(*map(table, range(SEGMENTS)))
    return fps.select("fp", "rep", F.explode(asked).alias("k")).select("k.t", "k.key", "fp", "rep")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct links (a, b), a < b, between representatives of distinct fingerprints."""
    if radius != RADIUS:
        raise ValueError("the four tables cover a radius of 2")
    q, x = probe_rows(fps).alias("q"), index_rows(fps).alias("x")
    near = F.bit_count(F.col("q.fp").bitwiseXOR(F.col("x.fp"))).between(1, radius)
    met = q.join(x, (F.col("q.t") == F.col("x.t")) & (F.col("q.key") == F.col("x.key")) & near)
    a, b = F.least("q.rep", "x.rep"), F.greatest("q.rep", "x.rep")
    return met.select(a.alias("a"), b.alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v), u > v; both keep the components."""
    if large:
        near = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).unionByName(edges)
    else:
        near = edges
    least = staged(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
    met = near.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return staged(out.where("u > v").distinct(), "cc-star")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that each node of an edge (a, b) can reach.

    Alternates large and small stars until no edge changes. Every step is an aggregation and
    an equi-join of two stored tables, so a node with very many edges is split by the
    adaptive skew join instead of filling one task.
    """
    here = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc-edges")
    seen = None
    while True:
        row = here.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        now = (row["n"], row["x"])
        if now == seen or not now[0]:
            break
        seen = now
        here = _star(_star(here, True), False)
    return here.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(ids: DataFrame) -> DataFrame:
    """(fp, root, component_id, n_links) of every distinct fingerprint of the stored rows (id, fp).

    root is the smallest fingerprint of the component and names it alone; component_id is the
    smallest id among its rows, null when none has an id.
    """
    fps = staged(ids.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    edges = staged(links(fps.select("fp", F.col("fp").alias("rep"))), "simhash-links")
    root = components(edges)
    root = staged(root.unionByName(root.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp"), "simhash-root")
    names = root.join(fps, "fp").groupBy("root").agg(F.min("id").alias("name"))
    ends = edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    linked = staged(root.join(names, "root").join(ends, "fp"), "simhash-linked")
    of = fps.join(linked, "fp", "left")
    return staged(of.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("name", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "simhash-class")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: id_col, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest id reachable over links of at most two differing bits, itself
    included. n_links counts the different fingerprints that the row's fingerprint links to.
    """
    ids = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    of = _classes(ids)
    return ids.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the first by id (null last), hash of the text, hash of the row.

    The three together are a row's key, which every task computes alike from the row itself, so
    texts are shuffled once and not stored. Only rows that are equal in every column share a
    key; of those, which are met by their count, one stays.
    """
    columns = docs.columns
    p = free_prefix(*columns)
    text_hash = F.xxhash64(F.lit("text"), column(text_col).cast("string"))
    # A null adds nothing to a hash, so whether a column is null is hashed beside it.
    row_hash = F.xxhash64(F.lit("row"), *[x for f in docs.schema.fields for x in (column(f.name).isNull(), _plain(column(f.name), f.dataType))])
    ids = staged(fingerprints(docs, id_col, text_col, shingle, {"text_hash": text_hash, "row_hash": row_hash}), "simhash-fp")
    per = ids.groupBy("fp", "id", "text_hash", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "row_hash", "n")
    firsts = per.groupBy("fp").agg(F.min(order).alias("first"))
    kept = firsts.join(_classes(ids.select("id", "fp")), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = staged(kept.select(F.col("first.id").alias(p + "id"), F.col("first.text_hash").alias(p + "text"), F.col("first.row_hash").alias(p + "row"), (F.col("first.n") > 1).alias(p + "many")), "simhash-kept")

    def of(many: bool) -> DataFrame:
        key = kept.where(F.col(p + "many") == many)
        same = docs_id.eqNullSafe(F.col(p + "id")) & (F.col(p + "text") == text_hash) & (F.col(p + "row") == row_hash)
        return docs.join(key, same)

    docs_id = column(id_col).cast("long")
    out = of(False).select(*map(column, columns))
    if not kept.where(p + "many").isEmpty():
        # Equal rows meet by map-side partial aggregation, so a row however frequent is one row a task.
        told = of(True).groupBy(p + "id", p + "text", p + "row").agg(F.first(F.struct(*map(column, columns))).alias(p + "first"))
        out = out.unionByName(told.select(*[F.col(p + "first").getField(c).alias(c) for c in columns]))
    return out


def _plain(value: Column, kind: T.DataType) -> Column:
    """A value as what can be hashed: maps, alone or nested, as their JSON."""
    return F.to_json(F.struct(value.alias("v"))) if "map<" in kind.simpleString() else value
