"""An index of cells with product-quantised vectors.

Items lie in cells by their nearest centre. What a vector is beyond its centre is cut into
sub-vectors, and each is stored as one byte, the nearest of 256 code vectors learned for its place.
A query looks into the cells nearest to it; there a score is the product with what
a code stands for, the centre plus a code vector for each byte. The best of a lot by these scores are scored anew with their
whole vectors where the lot is read, so a query sends on k rows a lot.

Centres and code vectors are learned from a bounded sample; every item is coded. The codes are a
stored table (lot, item, cell, code, vector) that grows by a byte a sub-vector, an id and the vector an
item. Lots are cut by a hash of the item, so a task holds one lot, a part of every cell, and a block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.candidates import (
    CLOSE, DIGITS, QUERIES, TILE_I, TILE_Q, Lists, _found, _plain, _reaching, blocks_of, cells_for, exact_lists, in_blocks, ivf_cells, knn_exact, lot_of, matrix, nearest_cells, probed,
    probes_for, top_k,
)
from larkspur.sources.shared import ship, staged

CODES = 256
#: Items a lot, and vectors that code vectors are learned from.
LOT, SAMPLE = 10_000, 20_000
#: Share of the exact lists that as many cells are looked into for.
RECALL = 0.95


@dataclass
class Index:
    """Centres (cells x dimensions), code vectors (sub-vectors x CODES x width) and the stored tables of codes and vectors."""

    centres: np.ndarray
    codebooks: np.ndarray
    codes: DataFrame
    vectors: DataFrame
    size: int


def learn_codebooks(rows: np.ndarray, parts: int, seed: int = 42, rounds: int = 12) -> np.ndarray:
    """Code vectors of each sub-vector by Lloyd's rounds; a code that nothing is nearest to moves to a random row."""
    n, wide = rows.shape
    if parts < 1 or wide % parts:
        raise ValueError("the number of sub-vectors must divide the dimensions")
    rng = np.random.default_rng(seed)
    out = np.zeros((parts, CODES, wide // parts))
    for j in range(parts):
        x = rows[:, j * (wide // parts) : (j + 1) * (wide // parts)]
        code = x[rng.integers(0, n, CODES)] if n < CODES else x[rng.choice(n, CODES, replace=False)]
        for _ in range(rounds):
            near = nearest(x, code)
            size = np.bincount(near, minlength=CODES)
            sums = np.stack([np.bincount(near, x[:, d], CODES) for d in range(x.shape[1])], 1)
            code = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(0, n, CODES)])
        out[j] = code
    return out


def nearest(x: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((code * code).sum(1) - 2 * x @ code.T).argmin(1)


def encoded(rows: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    width = codebooks.shape[2]
    return np.stack([nearest(rows[:, j * width : (j + 1) * width], book) for j, book in enumerate(codebooks)], 1).astype(np.uint8)


def build(items: DataFrame, parts: int = 16, cells: int | None = None, seed: int = 42) -> Index:
    """An index over (item, vector); all vectors have one length, which ``parts`` divides."""
    ship(items.sparkSession)
    vectors = staged(_plain(items, "item"), "pq-vectors")
    n = vectors.count()
    centres, placed = ivf_cells(vectors, cells or cells_for(n), seed)
    placed = staged(placed, "pq-placed")
    # A bounded sample, by a hash of the item, of what vectors are beyond their centre.
    share = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
    some = placed.where(F.pmod(F.xxhash64(F.lit("codes"), "item"), F.lit(1 << 20)) < share).select("cell", "vector").toArrow()
    rest = matrix(some["vector"]) - centres[np.asarray(some["cell"])] if some.num_rows else np.zeros((1, centres.shape[1]))
    codebooks = learn_codebooks(rest, parts, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                table = pa.Table.from_batches([b])
                code = encoded(matrix(table["vector"]) - centres[np.asarray(table["cell"])], codebooks)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), b.column(2)], ["item", "cell", "code", "vector"])

    codes = placed.select("item", F.col("cell").cast("int").alias("cell"), "vector").mapInArrow(run, "item long, cell int, code binary, vector array<double>")
    return Index(centres, codebooks, staged(codes.select(lot_of(n, LOT), "item", "cell", "code", "vector"), "pq-codes"), vectors, n)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, rescored: int = 16, recall: float = RECALL, some: int | None = None) -> DataFrame:
    """(request, item, score, rank): the k best of the ``rescored`` x k items of each lot that the codes call best.

    Without ``probes`` there are as many cells as a sample of the queries needs to hold ``recall`` of their lists.
    With ``some`` only the first so many lots are searched.
    """
    if k < 1 or rescored < 1:
        raise ValueError("k and rescored must be positive")
    ship(queries.sparkSession)
    queries = staged(_plain(queries, "request"), "pq-queries")
    if probes is None:
        placed = index.codes.select("item", "cell")
        probes = probes_for(queries, index.vectors, placed, index.centres, k, recall)
    lots = blocks_of(index.size, LOT) if some is None else some
    codes = index.codes if some is None else index.codes.where(F.col("lot") < some)
    return top_k(in_blocks(queries, codes, QUERIES, lots, _best(index.centres, index.codebooks, k, probes, k * rescored)), k)


def _reached(q: np.ndarray, floor: np.ndarray, v: np.ndarray, told: np.ndarray, item: np.ndarray, cell: np.ndarray, centres: np.ndarray, probes: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, place, score) by tiles of queries: of the ``most`` best by (product with ``told`` desc, item) of the cells looked into, those whose score reaches the query's floor.

    The other way round than without a floor: few items reach it, so these are found first, and only their queries' lots are put in the order of the codes.
    """
    step, n = max(1, TILE_Q * TILE_I // len(item)), len(item)
    for a in range(0, len(q), step):
        row, at, worth = _reaching(q[a : a + step] @ v.T, floor[a : a + step])
        rows, own = np.unique(row, return_inverse=True)
        tile = q[a + rows]
        chosen = nearest_cells(tile @ centres.T, probes)
        keep = (worth >= floor[a + row]) & chosen[own, cell[at]]
        if n > most:
            codes = tile @ told.T
            np.copyto(codes, -np.inf, where=~chosen[:, cell])
            last, mine = np.partition(codes, n - most, axis=1)[:, n - most][own], codes[own, at]
            keep &= mine >= last - CLOSE
            for i in np.flatnonzero(keep & (mine <= last + CLOSE)).tolist():  # at the end of the order, where nine digits and the item count
                rounded = codes[own[i]].round(DIGITS)
                keep[i] = (rounded > rounded[at[i]]).sum() + ((rounded == rounded[at[i]]) & (item < item[at[i]])).sum() < most
        yield row[keep] + a, at[keep], worth[keep]


def _best(centres: np.ndarray, codebooks: np.ndarray, k: int, probes: int, most: int):
    """A cogroup function: the k best items of a lot for each query of a block, of the ``most`` that the codes call best."""

    def best(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return _found(*[np.zeros(0)] * 3)
        q, v, request, item, cell = matrix(asked["vector"]), matrix(there["vector"]), np.asarray(asked["request"]), np.asarray(there["item"]), np.asarray(there["cell"])
        floor = np.asarray(asked["floor"])
        code = np.frombuffer(b"".join(there["code"].to_pylist()), np.uint8).reshape(there.num_rows, -1)
        told = np.concatenate([book[code[:, j]] for j, book in enumerate(codebooks)], 1) + centres[cell]
        scorer = lambda tile, near: lambda rows, places, cells: tile[rows] @ told[places].T
        out = []
        free, bound = np.flatnonzero(np.isneginf(floor)), np.flatnonzero(~np.isneginf(floor))
        for row, at, _ in probed(scorer, q[free], centres, probes, cell, item, most):
            row = free[row]
            worth = np.concatenate([np.einsum("nd,nd->n", q[row[a : a + 20_000]], v[at[a : a + 20_000]]) for a in range(0, len(row), 20_000)] or [np.zeros(0)]).round(DIGITS)
            # Nothing below the worst of a row's first k by codes is sorted again.
            nth, low = np.arange(len(row)) - np.searchsorted(row, row), np.full(len(q), np.inf)
            np.minimum.at(low, row[nth < k], worth[nth < k])
            least = np.full(len(q), -np.inf)
            least[row[nth == k - 1]] = low[row[nth == k - 1]]
            high = worth >= least[row]
            out.append((row[high], at[high], worth[high]))
        out += [(bound[row], at, worth) for row, at, worth in _reached(q[bound], floor[bound], v, told, item, cell, centres, probes, most)]
        for i, (row, at, worth) in enumerate(out):
            first = np.lexsort((item[at], -worth, row))
            first = first[np.arange(len(first)) - np.searchsorted(row[first], row[first]) < k]
            out[i] = request[row[first]], item[at[first]], worth[first]
        return _found(*[np.concatenate(x) for x in zip(*out, strict=True)])

    return best


def lists(queries: DataFrame, items: DataFrame, k: int) -> Lists:
    """For ``candidates.listed``, the search of ``knn_ivfpq``; how many cells a query looks into is measured over ``queries``, of which later ones are a part."""
    n = items.count()
    if cells_for(n) < 2:
        return exact_lists(items, k)
    index = build(items)
    probes = probes_for(_plain(queries, "request"), index.vectors, index.codes.select("item", "cell"), index.centres, k, RECALL)
    return blocks_of(n, LOT), lambda asked, some: search(index, asked, k, probes, some=some)


def knn_ivfpq(queries: DataFrame, items: DataFrame, k: int, parts: int = 16, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """As ``knn_exact``, through an index built here; few items are searched exactly."""
    n = items.count()
    if (cells_for(n) if cells is None else cells) < 2:
        return knn_exact(queries, items, k)
    return search(build(items, parts, cells), queries, k, probes)


def knn(queries: DataFrame, items: DataFrame, k: int, exact_below: int = 20_000) -> DataFrame:
    """The nearest items, exactly among fewer than ``exact_below``, else through the index, whose recall is measured on a sample of the queries."""
    items, queries = staged(items.select("item", "vector"), "knn-catalogue"), staged(queries.select("request", "vector"), "knn-asked")
    return knn_exact(queries, items, k) if items.limit(exact_below).count() < exact_below else knn_ivfpq(queries, items, k)
