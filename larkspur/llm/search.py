"""Ranked lexical search over term-bucketed postings.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII; A to Z are
lower-cased. ``postings`` gives a row for each term of each document, (bucket, term, row, id, tf,
n), and one row without a term for each document, from which the counts over all documents come.
The table is stored; inside each file rows lie by bucket, a hash of the term, so that a term's
postings stand together and documents stay apart in files.

``search`` joins the terms of the items, scores each match in integers, sums by item and
document, and numbers an item's documents. The score of a document m long is the sum, over the
item's terms once each, of w * ((10^9 * tf) div (1000 * tf + 20 * m)).

Defined results: a null or empty text has no term and is never found; an item without terms, or
whose terms no document holds, has no rows; rows of one item id are one item; rows of one document
id are documents of their own; a null id comes after others among equal scores; an empty table gives an empty result; extra columns are
ignored. A very long text is a slice of its own.

Cost: texts are read once and only terms that items have leave the workers (their hashes are sent
to the workers if there are at most ``MOST_SENT``, else all postings are stored and joined). The
sums of a document begin in the task that holds its postings, so one row for each item and
document that share a term is shuffled, and of each task at most k rows an item reach the last
window. A term's weight and an item's terms are one table that is sent to all tasks if it has at
most ``MOST_SENT`` rows; a larger one is joined by a shuffle of both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import column, ship, staged
from larkspur.llm.words import TERM, word_slices

#: Rows of a table of terms that may be sent to every task: some 20 MB.
MOST_SENT = 200_000
BUCKETS = 256
_SLICE = 1 << 19
_POSTING = "bucket int, term string, row long, id long, tf long, n long"


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: list[str] | None = None) -> DataFrame:
    """Postings of all terms, or of the terms ``asked`` only, and a row without a term for each document."""
    ship(docs.sparkSession)
    wanted = None
    if asked is not None:
        told = pa.array(sorted(set(asked)), pa.string())
        wanted = {t: i for i, t in enumerate(told.to_pylist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = names = None
        if wanted is not None:
            names = pa.array(wanted, pa.string())
            keys = next(iter(_hashes(names)))
            order = np.argsort(keys)
            keys, names = keys[order], names.take(pa.array(order))
        for batch, w in word_slices(batches, 2, TERM, _SLICE):
            n = w.counts()
            if keys is None:
                there, slot, back = np.arange(len(w.hashes)), *np.unique(w.hashes, return_inverse=True)
                of = back
            else:
                of = np.minimum(np.searchsorted(keys, w.hashes), max(len(keys) - 1, 0)) if len(keys) else np.zeros(len(w.hashes), int)
                there = np.flatnonzero(keys[of] == w.hashes) if len(keys) else np.zeros(0, int)
                of, slot = of[there], keys
            pair, first, tf = np.unique(w.row[there] * max(len(slot), 1) + of, return_index=True, return_counts=True)
            row, at = pair // max(len(slot), 1), pair % max(len(slot), 1)
            term = names.take(pa.array(at)) if names is not None else pa.array(w.said(there[first]), pa.string())
            bucket = (slot[at] % np.uint64(BUCKETS)).astype(np.int32) if len(at) else np.zeros(0, np.int32)
            rows, ids = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(bucket), pa.nulls(len(n), pa.int32())]), pa.concat_arrays([term.cast(pa.string()), pa.nulls(len(n), pa.string())]),
                    pa.concat_arrays([rows.take(pa.array(row)), rows]), pa.concat_arrays([ids.take(pa.array(row)), ids]),
                    pa.array(np.concatenate((tf, np.zeros(len(n), np.int64)))), pa.array(np.concatenate((n[row], n))),
                ],
                ["bucket", "term", "row", "id", "tf", "n"],
            )

    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(run, _POSTING)


def _hashes(names: pa.Array) -> Iterator[np.ndarray]:
    batch = pa.RecordBatch.from_arrays([names], ["t"])
    for _, w in word_slices(iter([batch]), 0, TERM, 1 << 40):
        yield w.hashes
        return
    yield np.zeros(0, np.uint64)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item."""
    found = postings(items.select(column(id_col).alias("doc_id"), column(text_col).alias("text")))
    return found.where("term is not null").select(F.col("id").alias("item"), "term").distinct()


def weight(n: Column, df: Column) -> Column:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double")))


def gain(w: Column, tf: Column, n: Column, n_docs: Column, length: Column) -> Column:
    """One term's share of a document's score, all 64-bit integers."""
    div = lambda a, b: F.call_function("div", a, b)
    m = 50 + div(50 * n * n_docs, length)
    return w * div(F.lit(1_000_000_000).cast("long") * tf, 1000 * tf + 20 * m)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): each item's ``k`` highest-scoring documents, equal scores by id."""
    if k < 1:
        raise ValueError("k must be positive")
    asked = staged(item_terms(items, item_col, item_text), "search-items")
    few = asked.limit(MOST_SENT + 1).count() <= MOST_SENT
    names = [r["term"] for r in asked.select("term").distinct().collect()] if few else None  # at most MOST_SENT
    index = staged(postings(docs, id_col, text_col, names).sortWithinPartitions("bucket", "term"), "search-postings")
    total = index.where("term is null and n > 0").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"))
    held = index.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(held, "term").join(F.broadcast(total)).select("item", "term", weight(F.col("n_docs"), F.col("df")).alias("w"), "n_docs", "length")  # one row
    weights = staged(weights, "search-weights")
    met = index.where("term is not null").join(F.broadcast(weights) if few else weights, "term")
    sums = met.groupBy("item", "row", "id").agg(F.sum(gain(F.col("w"), F.col("tf"), F.col("n"), F.col("n_docs"), F.col("length"))).alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
