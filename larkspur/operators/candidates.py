"""Candidate retrieval, blending and re-ranking.

Retrieval lists are long: (request, source, rank, item). Only greedy slates with similarity or
exploration are filled slot by slot; Arrow batches hold many requests, which advance together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import digest_number, digest_uniform, dot
from larkspur.sources.shared import dealt, ship, staged

#: Rank of an item that a source didn't return.
ABSENT = 10_000


def top_k(scores: DataFrame, k: int, keys: Sequence[str] = ("request",), positive_only: bool = False) -> DataFrame:
    """The k best rows of each key by (score desc, item), with their rank from 1."""
    if k < 1:
        raise ValueError("k must be positive")
    rows = scores.where("score > 0") if positive_only else scores
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows of queries and of items whose scores are held at a time.
TILE_Q, TILE_I = 1000, 4000
#: Items a cell at least, so that its centre can be learned, and cells at most.
PER_CELL, MOST_CELLS = 39, 4096


def matrix(column: pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """A column of lists of one length as rows."""
    flat = np.concatenate([np.asarray(c.flatten(), dtype) for c in column.chunks] or [np.zeros(0, dtype)])
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


#: Scores are compared by nine digits. What comes this close to a bound is rounded first, so not all scores of a tile are.
DIGITS, CLOSE = 9, 2e-9


def _reaching(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of all scores of a row that reach its ``least`` when both are rounded, and some that just don't."""
    at = np.flatnonzero(scores >= np.maximum(least - CLOSE, np.finfo(float).min)[:, None])
    return *np.divmod(at, scores.shape[1]), scores.ravel()[at].round(DIGITS)


def _first_floor(scores: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """``floor``, and for rows that have none yet the k-th best of their scores."""
    new = np.flatnonzero(np.isneginf(floor))
    if len(new) and scores.shape[1] > k:
        floor = floor.copy()
        floor[new] = np.partition(scores if len(new) == len(scores) else scores[new], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return floor


def winners(score, request: np.ndarray, item: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(request, item, score): the k best of each request by (score desc, item); ``score(a, b, at)`` scores requests a to b with the items at ``at``.

    Scores are made tile by tile beside the best so far, so memory is that of a tile. Below a request's
    entry of ``floors`` nothing is looked for.
    """
    order = np.argsort(item, kind="stable")
    out = []
    for a in range(0, len(request), TILE_Q):
        b = min(a + TILE_Q, len(request))
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # row, place of the item, score
        floor = np.full(b - a, -np.inf) if floors is None else floors[a:b].copy()
        for c in range(0, len(item), TILE_I):
            scores = score(a, b, order[c : c + TILE_I])
            # Below the last of a full list nothing is taken, so later tiles are only compared.
            row, at, worth = _reaching(scores, floor if c else _first_floor(scores, floor, k))
            if not len(row):
                continue
            held = [np.concatenate(x) for x in zip(held, (row, at + c, worth), strict=True)]
            first = np.lexsort((held[1], -held[2], held[0]))
            starts = np.searchsorted(held[0][first], np.arange(b - a))
            place = np.arange(len(first)) - starts[held[0][first]]
            held = [x[first[place < k]] for x in held]
            floor[held[0][place[place < k] == k - 1]] = held[2][place[place < k] == k - 1]
        out.append((request[a:b][held[0]], item[order][held[1]], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = q @ v.T
    return np.round(out, DIGITS, out=out)


#: Items a block of an index, queries a block, and scores of a tile of queries that wait to be merged.
LOT, QUERIES, WAITING = 10_000, 20_000, 1_000_000


def nearest_cells(near: np.ndarray, probes: int) -> np.ndarray:
    """Of the products of queries with centres, which are the ``probes`` largest of a query."""
    chosen = np.full(near.shape, probes >= near.shape[1])
    if probes < near.shape[1]:
        np.put_along_axis(chosen, np.argpartition(-near, probes - 1, axis=1)[:, :probes], True, 1)
    return chosen


def probed(scorer, q: np.ndarray, centres: np.ndarray, probes: int, cell: np.ndarray, item: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, place, score) by tiles of queries: the ``most`` best by (score desc, item) of the items in the ``probes`` nearest cells of each query.

    ``scorer(tile, near)`` gives a function of some of a tile's rows, places of items and the cells of these; ``near`` has the products with the centres.
    Where queries look into many cells, or cells are small, the items of several cells are scored at once and those that a query doesn't look into are left out after that.
    """
    order = np.lexsort((item, cell))
    own, n = cell[order], len(order)
    small = lambda x, most: x.astype(np.uint16) if most <= 1 << 16 else x  # noqa: E731 - sorted by radix
    turn = small(np.argsort(np.argsort(item, kind="stable")), n)
    cuts = {*range(0, n, TILE_I)}
    if 4 * probes < len(centres) and n >= 8 * len(centres):
        cuts |= {*(np.flatnonzero(np.diff(own)) + 1).tolist()}
    cuts = [*sorted(cuts), n]
    for a in range(0, len(q), TILE_Q):
        tile = q[a : a + TILE_Q]
        near = tile @ centres.T
        chosen = nearest_cells(near, probes)
        score, floor, waiting = scorer(tile, near), np.full(len(tile), -np.inf), 0
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def merge(floor: np.ndarray, held: list) -> None:
            row, at, worth = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.lexsort((turn[at], -worth, small(row, TILE_Q)))
            starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(floor)))))
            place = np.arange(len(first)) - starts[row[first]]
            first, place = first[place < most], place[place < most]
            held[:] = [(row[first], at[first], worth[first])]
            floor[held[0][0][place == most - 1]] = held[0][2][place == most - 1]

        for b, d in zip(cuts, cuts[1:], strict=False):
            there, sizes = np.unique(own[b:d], return_counts=True)
            looks = chosen[:, there]
            asks = np.flatnonzero(looks.any(1))
            if not len(asks):
                continue
            worth = score(asks, order[b:d], own[b:d])
            np.copyto(worth, -np.inf, where=~np.repeat(looks[asks], sizes, axis=1))
            row, at, worth = _reaching(worth, _first_floor(worth, floor[asks], most))
            held.append((asks[row], order[b:d][at], worth))
            waiting += len(row)
            if waiting > WAITING:
                merge(floor, held)
                waiting = 0
        merge(floor, held)
        yield held[0][0] + a, held[0][1], held[0][2]


def in_blocks(queries: DataFrame, items: DataFrame, size: int, lots: int, best) -> DataFrame:
    """(request, item, score) of ``best(asked, there)`` over blocks of at most about ``size`` of the stored ``queries`` with each lot of ``items``, whose column lot is below ``lots``.

    There are as many tasks as meetings, so that none waits behind another because both fell into one partition of few;
    few lots are met by more and smaller blocks. ``asked`` has a column floor: scores below it needn't come out.
    """
    least, n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), queries.count()
    blocks = max(blocks_of(n, size), min(blocks_of(n, TILE_Q), blocks_of(least, lots)))
    floor = F.col("floor") if "floor" in queries.columns else F.lit(float("-inf"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("request", "vector", floor.alias("floor"), F.pmod(F.xxhash64("request"), F.lit(blocks)).cast("int").alias("__q"), every(lots).alias("__b"))
    there = items.withColumnRenamed("lot", "__b").withColumn("__q", every(blocks))
    met = [df.repartition(max(least, blocks * lots), "__q", "__b").groupBy("__q", "__b") for df in (asked, there)]
    return met[0].cogroup(met[1]).applyInArrow(best, "request long, item long, score double")


def blocks_of(n: int, size: int) -> int:
    return max(1, -(-n // size))


def lot_of(n: int, size: int) -> Column:
    """The lot of an item among n: by its hash, so that a cell of many items lies in all lots."""
    return F.pmod(F.xxhash64("item"), F.lit(blocks_of(n, size))).cast("int").alias("lot")


def _found(request: np.ndarray, item: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"request": pa.array(request, pa.int64()), "item": pa.array(item, pa.int64()), "score": pa.array(score, pa.float64())})


def _block_winners(k: int):
    """A cogroup function: the k best items of a block for each query of a block, by (score desc, item)."""

    def best(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return _found(*[np.zeros(0)] * 3)
        q, v = matrix(asked["vector"]), matrix(there["vector"])
        # Rounded where they are taken, so that equal vectors tie wherever they stand in a product.
        score = lambda a, b, at: q[a:b] @ v[at].T
        floors = np.asarray(asked["floor"]) if "floor" in asked.column_names else None
        return _found(*winners(score, np.asarray(asked["request"]), np.asarray(there["item"]), k, floors))

    return best


def _plain(df: DataFrame, name: str) -> DataFrame:
    """(name, vector) as long and array<double>, and floor where ``df`` has it."""
    return df.select(F.col(name).cast("long").alias(name), F.col("vector").cast("array<double>").alias("vector"), *[c for c in ("floor",) if c in df.columns])


def knn_exact(queries: DataFrame, items: DataFrame, k: int, block_rows: int = 20_000) -> DataFrame:
    """(request, item, score, rank): the k items of the largest inner product with each query, ties by item.

    A stated query set is held against all items in blocks of about ``block_rows``: each block of
    queries meets each block of items once, as matrix products of ``TILE_Q`` x ``TILE_I`` scores with
    the best so far, and sends on k rows a query. Block winners meet per query. Memory is bounded by
    two blocks and a tile, whatever the number of rows. Both inputs are stored once, as they are
    counted and read.
    """
    if k < 1 or block_rows < 1:
        raise ValueError("k and block_rows must be positive")
    lots, search = exact_lists(items, k, block_rows)
    return search(queries, lots)


#: Lists of some lots of items, and how many lots there are; see ``listed``.
Lists = tuple[int, Callable[[DataFrame, int], DataFrame]]


def exact_lists(items: DataFrame, k: int, block_rows: int = 20_000) -> Lists:
    """The exact search for ``listed``; the items are stored here."""
    ship(items.sparkSession)
    items = staged(_plain(items, "item"), "knn-items")
    n = items.count()
    lots, there = blocks_of(n, block_rows), items.withColumn("lot", lot_of(n, block_rows))

    def search(queries: DataFrame, some: int) -> DataFrame:
        queries = staged(_plain(queries, "request"), "knn-queries")
        return top_k(in_blocks(queries, there.where(F.col("lot") < some) if some < lots else there, block_rows, some, _block_winners(k)), k)

    return lots, search


#: How many times as many lots the next lists of ``listed`` are made of.
GROWS = 8


def scored_pairs(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """(request, item, score, slack) of those ``pairs`` whose request and item have a vector; by ``slack`` a score may differ from that of a search."""
    some = staged(items.join(pairs.select("item").distinct(), "item", "left_semi").select("item", F.col("vector").alias("__v")), "scored-items")  # often few
    widest = items.agg(F.sqrt(F.max(dot(F.col("vector"), F.col("vector")))).alias("__w"))
    asked = queries.join(F.broadcast(widest)).select("request", F.col("vector").alias("__q"), (F.lit(1e-8) + F.lit(1e-12) * F.col("__w") * F.sqrt(dot(F.col("vector"), F.col("vector")))).alias("slack"))  # one row
    met = pairs.select("request", "item").join(asked, "request").join(some, "item").select("request", "item", dot(F.col("__q"), F.col("__v")).alias("score"), "slack")
    return met.withColumn("score", F.max("score").over(Window.partitionBy("request", "item")))  # an item listed twice is in a list by its better vector


def listed(pairs: DataFrame, queries: DataFrame, k: int, lists: Lists) -> DataFrame:
    """The rows of ``pairs``, of ``scored_pairs``, whose item is in the request's list of the k best of all lots.

    The last score of a full list of some lots is a bound: what is worse is not in the list of all lots. So lists
    are made of one lot first, then of ``GROWS`` times as many, each time only for requests with a pair that is
    still open, and at last of all lots. Whether an open pair is listed depends only on items that are no worse, so lists
    after the first leave out what is below a request's worst open pair. Each pair comes out as the lists of all requests would have it.
    """
    lots, search = lists
    pairs, queries = pairs.select("request", "item", "score", "slack"), queries.select("request", "vector", F.lit(float("-inf")).alias("floor"))
    queries = queries.join(pairs.select("request").distinct(), "request", "left_semi")
    some = 1
    while 4 * some <= lots:
        last = search(queries, some).where(F.col("rank") == k).select("request", F.col("score").alias("__last"))
        bound = F.col("__last") - F.col("slack")
        met = pairs.join(last, "request", "left").where(~F.coalesce((F.col("score") < bound) & ~F.isnan(bound), F.lit(False)))
        pairs = staged(met.select("request", "item", "score", "slack"), "open-pairs")
        # Without a bound, where few items were looked at, and where a score is no number, there is no floor.
        low = F.when(F.count_if(F.isnan("score") | F.isnan("slack") | F.col("score").isNull()) == 0, F.min(F.col("score") - F.col("slack")))
        queries = queries.drop("floor").join(pairs.groupBy("request").agg(F.coalesce(low, F.lit(float("-inf"))).alias("floor")), "request")
        some *= GROWS
    return pairs.join(search(queries, lots).select("request", "item"), ["request", "item"])


def cells_for(n: int) -> int:
    """Cells for n items: four times the square root, but so many items a cell as a centre needs."""
    return max(1, min(MOST_CELLS, int(4 * np.sqrt(n)), n // PER_CELL))


def ivf_cells(items: DataFrame, cells: int | None = None, seed: int = 42, sample: int = 50_000):
    """Cell centres by k-means over a bounded sample, and the items with their cell.

    Rounds are passes of Arrow tasks over the stored sample; the driver holds centres, and rows to choose the first from.
    ``sample`` is at least ``PER_CELL`` a cell. Cells that the sample can't fill don't come out.
    """
    n = items.count()
    cells = cells_for(n) if cells is None else min(cells, n // 2)  # some rows a centre
    if cells < 2:
        mean = [r["x"] for r in items.select(F.posexplode("vector").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x")).orderBy("p").collect()]  # a row a dimension
        return np.array([mean]) / max(np.linalg.norm(mean), 1e-12), items.select("item", "vector", F.lit(0).alias("cell"))
    ship(items.sparkSession)
    rows = items.select("item", F.col("vector").cast("array<double>").alias("vector"))
    share = min(1.0, max(sample, cells * PER_CELL) / max(n, 1))
    part = F.pmod(F.xxhash64("item"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    some = staged(rows.where(part), "ivf-sample")
    first = some.orderBy(F.xxhash64(F.lit(seed), F.col("item")), "item").limit(max(4 * cells, FIRST)).select("vector").toArrow()
    centres = _spread(matrix(first["vector"]), cells, seed)
    for _ in range(ROUNDS):
        told = _gathered(some, centres)
        sums, size = np.zeros_like(centres), np.bincount(np.asarray(told["cell"]), np.asarray(told["n"]), len(centres))
        np.add.at(sums, np.asarray(told["cell"]), matrix(told["sum"]))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    centres = centres[size > 0]
    kind = rows.schema["item"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _nearest_centre(matrix(pa.chunked_array([b.column(1)])), centres) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], ["item", "vector", "cell"])

    return centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None], rows.mapInArrow(place, f"item {kind}, vector array<double>, cell int")


#: Rounds of k-means, and rows at least that its first centres are chosen from.
ROUNDS, FIRST = 10, 4096


def _spread(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """At most ``cells`` rows of x far from each other: each next is drawn in proportion to the squared distance to the nearest before (k-means++)."""
    rng = np.random.default_rng(seed)
    norms, at = (x * x).sum(1), [int(rng.integers(len(x)))]
    far = np.full(len(x), np.inf)
    while True:
        far = np.minimum(far, np.maximum(norms + norms[at[-1]] - 2 * (x @ x[at[-1]]), 0))
        far[at[-1]] = 0
        ends = np.cumsum(far)
        if len(at) >= cells or not ends[-1] > 0:
            return x[at]
        at.append(min(int(np.searchsorted(ends, rng.random() * ends[-1], "right")), len(x) - 1))


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = (centres * centres).sum(1)
    return np.concatenate([(own - 2 * x[a : a + TILE_Q] @ centres.T).argmin(1) for a in range(0, len(x), TILE_Q)])


def _gathered(rows: DataFrame, centres: np.ndarray) -> pa.Table:
    """(cell, n, sum) of the rows nearest to each centre, a row a task and centre that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(pa.chunked_array([b.column(0)]))
                near = _nearest_centre(x, centres)
                order = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.diff(near[order], prepend=-1))
                sums[near[order][first]] += np.add.reduceat(x[order], first)
                size += np.bincount(near, minlength=len(centres))
        here = np.flatnonzero(size)
        if len(here):
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1) * sums.shape[1], pa.int32()), pa.array(sums[here].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(size[here], pa.int64()), flat], ["cell", "n", "sum"])

    return rows.select("vector").mapInArrow(run, "cell int, n long, sum array<double>").toArrow()


def _cells_by_nearness(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """``queries`` with ``near``, all cells from the nearest centre on; the centres are one row of ``cells`` vectors."""
    table = queries.sparkSession.createDataFrame([(centres.tolist(),)], "centres array<array<double>>")
    order = F.sort_array(F.transform("centres", lambda v, i: F.struct(dot(F.col("vector"), v).alias("d"), i.alias("cell"))), asc=False)
    return queries.join(F.broadcast(table)).select("request", "vector", F.transform(order, lambda x: x["cell"]).alias("near"))


def probes_for(queries: DataFrame, items: DataFrame, placed: DataFrame, centres: np.ndarray, k: int, recall: float, asks: int = 64) -> int:
    """How many cells a query has to look into for ``recall`` of its exact list, measured over about ``asks`` of the queries."""
    n = queries.count()
    part = F.pmod(F.xxhash64(F.lit("probes"), F.col("request")), F.lit(1 << 20)) < F.lit(int(min(1.0, asks / max(n, 1)) * (1 << 20)))
    some = queries.where(part)
    exact = knn_exact(some, items, k).select("request", "item")
    met = exact.join(placed.select("item", "cell"), "item").join(_cells_by_nearness(some, centres), "request")
    rows = met.groupBy(F.array_position("near", F.col("cell")).alias("at")).agg(F.count(F.lit(1)).alias("n")).orderBy("at").collect()  # a row a cell
    found, whole = 0, sum(r["n"] for r in rows)
    for r in rows:
        found += r["n"]
        if found >= recall * whole:
            return int(r["at"])
    return len(centres)


def knn_ivf(queries: DataFrame, items: DataFrame, k: int, cells: int | None = None, probes: int | None = None, seed: int = 42, recall: float = 0.95) -> DataFrame:
    """As ``knn_exact`` but only over the ``probes`` cells whose centre is nearest to the query.

    Without ``cells`` there are as many as ``cells_for`` says; where that is one, the search is exact.
    Without ``probes`` there are as many as a sample of the queries needs to reach ``recall``.
    A block of queries meets each lot of items once and sends on k rows a query, however many cells it looks into.
    """
    items, queries = staged(items.select("item", "vector"), "ivf-items"), staged(queries.select("request", "vector"), "ivf-queries")
    n = items.count()
    cells = cells_for(n) if cells is None else min(cells, n // 2)
    if cells < 2:
        return knn_exact(queries, items, k)
    centres, placed = ivf_cells(items, cells, seed)
    placed = staged(placed, "ivf-placed")
    probes = probes or probes_for(queries, items, placed, centres, k, recall)

    def best(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return _found(*[np.zeros(0)] * 3)
        q, v, request, item = matrix(asked["vector"]), matrix(there["vector"]), np.asarray(asked["request"]), np.asarray(there["item"])
        scorer = lambda tile, near: lambda rows, places, cells: tile[rows] @ v[places].T
        parts = list(probed(scorer, q, centres, probes, np.asarray(there["cell"]), item, k))
        row, at, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _found(request[row], item[at], score)

    ship(queries.sparkSession)
    there = placed.select(F.col("item").cast("long").alias("item"), "cell", F.col("vector").cast("array<double>").alias("vector"), lot_of(n, LOT))
    return top_k(in_blocks(_plain(queries, "request"), there, QUERIES, blocks_of(n, LOT), best), k)


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(request, agreement): the share of a's list that b's list holds."""
    lists = [df.groupBy("request").agg(F.collect_set("item").alias(n)) for df, n in ((a, "x"), (b, "y"))]
    met = lists[0].join(lists[1], "request", "left")
    return met.select("request", (F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0)) / F.lit(float(k))).alias("agreement"))


def blend(lists: DataFrame, sources: Sequence[str], quotas: Sequence[int], most: int) -> DataFrame:
    """(request, position, item): each source's quota in turn, then what is left in source order.

    ``lists`` has request, source, rank, item; item 0 is padding. Which of a source's items count
    against its quota depends on what earlier sources took, so a request's few lists are folded by
    one array expression.
    """
    if len(sources) != len(quotas):
        raise ValueError("a quota for each source")
    entry = F.struct("rank", F.col("item").cast("long").alias("item"))
    per = lists.where("item > 0").groupBy("request").pivot("source", list(sources)).agg(F.sort_array(F.collect_list(entry)))
    none = F.array().cast("array<bigint>")
    item = lambda s: F.coalesce(F.transform(F.col(f"`{s}`"), lambda x: x["item"]), none)
    chosen = none
    for s, quota in zip(sources, quotas, strict=True):
        fresh = F.array_distinct(F.array_except(item(s), chosen))
        chosen = F.slice(F.concat(chosen, F.slice(fresh, 1, quota) if quota else none), 1, most)
        per = per.withColumn("__chosen", chosen)
        chosen = F.col("__chosen")
    rest = F.array_distinct(F.flatten(F.array(*map(item, sources))))
    whole = F.slice(F.concat(chosen, F.array_except(rest, chosen)), 1, most)
    return per.select("request", F.posexplode(whole).alias("position", "item"))


def rank_columns(blended: DataFrame, lists: DataFrame, sources: Sequence[str]) -> DataFrame:
    """``blended`` with rank_<source> of each source (ABSENT where it hasn't the item) and n_sources."""
    ranks = lists.where("item > 0").groupBy("request", "item").pivot("source", list(sources)).agg(F.min("rank"))
    out = blended.join(ranks, ["request", "item"], "left")
    found = sum((F.col(f"`{s}`").isNotNull().cast("int") for s in sources[1:]), F.col(f"`{sources[0]}`").isNotNull().cast("int"))
    out = out.withColumn("n_sources", found)
    return out.withColumns({f"rank_{s}": F.coalesce(F.col(f"`{s}`"), F.lit(ABSENT)) for s in sources}).drop(*sources)


def attribution(lists: DataFrame, truth: DataFrame) -> DataFrame:
    """(source, hits, unique_hits): clicked items a source returned, and those no other did."""
    met = lists.select("request", "source", "item").distinct().join(truth.select("request", "item").distinct(), ["request", "item"])
    per = met.groupBy("request", "item").agg(F.collect_set("source").alias("s"))
    return per.select(F.explode("s").alias("source"), (F.size("s") == 1).alias("alone")).groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.count_if("alone").alias("unique_hits"))


def union_recall(lists: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, found, recall): the clicked items that any source returned."""
    hit = truth.select("request", "item").distinct().join(lists.select("request", "item").distinct().withColumn("__f", F.lit(1)), ["request", "item"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.count("__f").alias("found"), F.avg(F.coalesce("__f", F.lit(0))).alias("recall"))


def freshness(age_hours: Column, half_life_hours: float) -> Column:
    """2^(-age / half-life)."""
    if half_life_hours <= 0:
        raise ValueError("a half-life must be positive")
    return F.pow(F.lit(2.0), -age_hours / half_life_hours)


def capped(rows: DataFrame, k: int, cap: int) -> DataFrame:
    """The k best items of a request with at most ``cap`` of a category; where the cap leaves slots empty, the best of the rest fill them."""
    if k < 1 or cap < 1:
        raise ValueError("k and cap must be positive")
    best = [F.col("score").desc(), F.col("item")]
    rows = rows.withColumn("__over", F.row_number().over(Window.partitionBy("request", "category").orderBy(*best)) > cap)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("request").orderBy("__over", *best)))
    return rows.where(F.col("position") <= k).drop("__over")


_SLATE = "request long, position int, item long, propensity double"
#: Values of padded pools (requests x longest pool x dimensions) that a worker ranks at a time.
_TENSOR = 1 << 22
#: What an item without a score is worth: less than any that has one, but open to choice.
_LEAST = -1e300


def greedy_slates(rows: DataFrame, k: int, relevance: float = 1.0, cap: int | None = None, epsilon: float = 0.0, explore: int = 0, seed: int = 0) -> DataFrame:
    """(request, position, item, propensity): slots filled one after another, for many requests at a time.

    A slot takes the item of the largest relevance x score - (1 - relevance) x similarity, where
    similarity is the largest to what the slate holds, or 0. Where not all items are blocked,
    blocked ones are left out beforehand; a category at its cap waits unless nothing else is left;
    each of a slate's last ``explore`` slots is drawn uniformly among the open items with probability
    epsilon, and propensities say how likely each choice was. ``rows``: request, item, score, and
    where used vector (unit length), category, blocked. Draws are hashes of (seed, request, slot).
    A null or NaN score is below all others, by item among themselves; an item whose vector is null,
    or of another length than the pool's first, is similar to nothing.

    Each pool, a bounded list, becomes one row of arrays in order of (score desc, item). Arrow
    batches of them are padded to tensors and all slates of a tensor get their next slot at once.
    """
    if k < 1 or not 0 <= relevance <= 1 or not 0 <= epsilon <= 1:
        raise ValueError("k must be positive, relevance and epsilon in [0, 1]")
    if epsilon > 0 and explore < 1:
        raise ValueError("exploration needs slots")
    has = set(rows.columns)
    near, grouped = "vector" in has and relevance < 1, "category" in has and cap is not None
    worth = F.col("score").cast("double")
    worth = F.when(worth.isNull() | F.isnan(worth), F.lit(float("-inf"))).otherwise(worth)
    entry = F.struct(
        (-worth).alias("low"), F.col("item").cast("long").alias("item"), (F.col("category") if grouped else F.lit(None).cast("string")).alias("category"),
        (F.col("vector").cast("array<double>") if near else F.array().cast("array<double>")).alias("vector"), (F.coalesce("blocked", F.lit(False)) if "blocked" in has else F.lit(False)).alias("blocked"),
    )
    pools = rows.groupBy(F.col("request").cast("long").alias("request")).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    free = F.filter("all", lambda x: ~x["blocked"])
    pools = pools.select("request", F.when(F.size(free) > 0, free).otherwise(F.col("all")).alias("pool"))
    kinds = F.array_distinct(F.transform("pool", lambda x: F.coalesce(x["category"], F.lit(""))))
    slots = F.sequence(F.lit(0), F.lit(k - 1))
    wide = F.coalesce(F.size(F.try_element_at(F.filter("pool", lambda x: F.coalesce(F.size(x["vector"]), F.lit(-1)) > 0), F.lit(1))["vector"]), F.lit(0)) if near else F.lit(0)
    told_vector = lambda x: F.when(F.size(x["vector"]) == F.col("__wide"), F.transform(x["vector"], lambda v: F.coalesce(v, F.lit(0.0)))).otherwise(F.array_repeat(F.lit(0.0), F.col("__wide")))
    draw = lambda salt: F.transform(slots, lambda i: digest_uniform(F.lit(str(seed)), F.col("request").cast("string"), i.cast("string"), F.lit(salt)))
    told = pools.withColumn("__wide", wide).select(
        "request", F.transform("pool", lambda x: x["item"]).alias("items"), F.transform("pool", lambda x: -x["low"]).alias("scores"),
        F.transform("pool", lambda x: F.array_position(kinds, F.coalesce(x["category"], F.lit(""))).cast("int") - 1).alias("kinds"), F.flatten(F.transform("pool", told_vector)).alias("vectors"),
        *[(draw(salt) if epsilon > 0 else F.array().cast("array<double>")).alias(salt) for salt in ("explores", "picks")],
    )
    rules = (k, relevance if near else 1.0, cap if grouped else None, epsilon, explore)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(batch.column(i).flatten()) for i in range(1, 7)]
            ends = [np.concatenate(([0], np.cumsum(batch.column(i).value_lengths().to_numpy(zero_copy_only=False)))) for i in range(1, 7)]
            requests, sizes = np.asarray(batch.column(0)), np.diff(ends[0])
            wide = np.diff(ends[3]) // np.maximum(sizes, 1)
            at = 0
            while at < len(requests):
                # As many requests as fit the bound when padded to the longest pool among them.
                most = np.maximum.accumulate(sizes[at:]) * max(1, int(wide.max())) * np.arange(1, len(sizes) - at + 1)
                to = at + max(1, int(np.searchsorted(most, _TENSOR, "right")))
                part = [values[e[at] : e[to]] for values, e in zip(lists, ends, strict=True)]
                yield _ranked(requests[at:to], sizes[at:to], wide[at:to], part, rules)
                at = to

    ship(rows.sparkSession)
    return told.mapInArrow(run, _SLATE)


def _ranked(requests: np.ndarray, sizes: np.ndarray, wide: np.ndarray, lists: list[np.ndarray], rules: tuple) -> pa.RecordBatch:
    """The slates of a few requests whose pools' items, scores, categories, vectors and draws stand one after another; ``wide`` is the length of a request's vectors."""
    k, relevance, cap, epsilon, explore = rules
    items, scores, kinds, vectors, explores, picks = lists
    here = np.arange(sizes.max()) < sizes[:, None]  # requests x places
    every, slots = np.arange(len(sizes)), np.minimum(k, sizes)

    def padded(values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(here.shape, fill, values.dtype)
        out[here] = values
        return out

    score, kind = padded(scores, -np.inf), padded(kinds, 0)
    worth = np.where(np.isneginf(score), _LEAST, relevance * np.where(np.isneginf(score), 0, score))
    unit = None
    if relevance < 1:
        unit = np.zeros((*here.shape, int(wide.max())))
        ends = np.cumsum(wide * sizes)
        for r, (n, w, end) in enumerate(zip(sizes.tolist(), wide.tolist(), ends.tolist(), strict=True)):
            unit[r, :n, :w] = vectors[end - n * w : end].reshape(n, w)
    name, left = padded(items, 0), here.copy()
    shown = np.zeros((len(sizes), int(kind.max()) + 1), int)
    alike, done = np.zeros(here.shape), []
    for slot in range(int(slots.max())):
        going = slot < slots
        room = left & (np.take_along_axis(shown, kind, 1) < cap) if cap is not None else left
        room = np.where(room.any(1)[:, None], room, left)
        pick = np.where(room, worth - (1 - relevance) * alike, -np.inf).argmax(1)
        chance = np.ones(len(sizes))
        if epsilon > 0:
            n, late = room.sum(1), slot >= slots - explore
            drawn = (np.cumsum(room, 1) > np.floor(picks.reshape(-1, k)[:, slot] * n)[:, None]).argmax(1)
            moved = np.where(explores.reshape(-1, k)[:, slot] < epsilon, drawn, pick)
            chance = np.where(late, epsilon / np.maximum(n, 1) + (1 - epsilon) * (moved == pick), 1.0)
            pick = np.where(late, moved, pick)
        done.append((requests[going], np.full(going.sum(), slot), name[every, pick][going], chance[going]))
        left[every, pick] = False
        shown[every, kind[every, pick]] += 1
        if unit is not None:
            alike = np.maximum(alike, np.einsum("rnd,rd->rn", unit, unit[every, pick]))
    columns = [np.concatenate(c) for c in zip(*done, strict=True)]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["request", "position", "item", "propensity"])


def seen_filter(candidates: DataFrame, shown: DataFrame) -> DataFrame:
    """Candidates without what the same user was shown before the request's instant."""
    past = shown.select(F.col("user_id").alias("__u"), F.col("item").alias("__i"), F.col("ts").alias("__t")).groupBy("__u", "__i").agg(F.min("__t").alias("__t"))
    on = (F.col("user_id") == F.col("__u")) & (F.col("item") == F.col("__i")) & (F.col("__t") < F.col("ts"))
    return candidates.join(past, on, "left_anti")


def replay_unseen(pools: DataFrame, k: int, ttl_seconds: int | None = None) -> DataFrame:
    """(request, position, item, blocked): each request's slate when what its user was served before is blocked.

    ``pools``: user_id, request, ts, item, score. A user's requests are replayed in order of (ts,
    request): a slate is the k best by (score desc, item) of what isn't blocked, or of all where
    everything is, and blocks its items for the requests after it. With ``ttl_seconds`` a user's list
    ends when nothing was served for longer than that. ``blocked`` counts the request's blocked
    candidates. A null score is below all others.

    A slate depends on the slates before, so a user's requests go through one task in order; they are
    streamed, sorted, and the task holds one pool and the items that this user was served.
    """
    best = F.col("score").cast("double")
    best = F.when(F.isnan(best), F.lit(None)).otherwise(best)
    place = F.struct(best.isNull().alias("none"), (-best).alias("by"), F.col("item").cast("long").alias("item"))
    lists = pools.repartition("user_id").groupBy("user_id", "ts", "request").agg(F.sort_array(F.collect_list(place)).alias("pool"))
    return _replayed(lists.withColumn("pool", F.transform("pool", lambda x: x["item"])), k, ttl_seconds)


def replay_ranked(requests: DataFrame, rank: Callable[[DataFrame], DataFrame], k: int, ttl_seconds: int | None = None) -> DataFrame:
    """``replay_unseen`` over requests that hold their whole pool in a row.

    ``requests``: user_id, request, ts and what ``rank`` needs, which adds ``pool``, a request's items,
    best first. It gets the requests dealt by user, in tasks whose memory doesn't grow with their number.
    """
    return _replayed(rank(dealt(requests, requests.count(), "user_id")), k, ttl_seconds)


def _replayed(requests: DataFrame, k: int, ttl_seconds: int | None) -> DataFrame:
    """Slates of requests that are dealt by user_id and have their pool in order."""
    if k < 1 or (ttl_seconds is not None and ttl_seconds < 1):
        raise ValueError("k and ttl_seconds must be positive")
    ship(requests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = last = None
        seen: set[int] = set()
        for batch in batches:
            pools = batch.column(3)
            items, ends = pools.flatten().to_pylist(), np.cumsum(pools.value_lengths().to_numpy()).tolist()
            slates: list[int] = []
            sizes, blocked, start = [], [], 0
            for u, us, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, strict=True):
                if u != user or (ttl_seconds is not None and us - last > ttl_seconds * 1_000_000):
                    seen = set()
                user, last, pool, start = u, us, items[start:end], end
                free = [i for i in pool if i not in seen]
                slate = (free or pool)[:k]
                slates += slate
                sizes.append(len(slate))
                blocked.append(len(pool) - len(free))
                seen.update(slate)
            n = np.array(sizes, dtype=np.int64)
            position = np.arange(len(slates)) - np.repeat(np.cumsum(n) - n, n)
            requests = batch.column(2).take(pa.array(np.repeat(np.arange(len(n)), n)))
            columns = [requests, pa.array(position.astype(np.int32)), pa.array(slates, pa.int64()), pa.array(np.repeat(np.array(blocked, dtype=np.int32), n))]
            yield pa.RecordBatch.from_arrays(columns, ["request", "position", "item", "blocked"])

    rows = requests.sortWithinPartitions("user_id", "ts", "request").select("user_id", F.unix_micros("ts"), F.col("request").cast("long").alias("request"), "pool")
    return rows.mapInArrow(run, "request long, position int, item long, blocked int")


def bloom_size(capacity: Column, rate: float) -> tuple[Column, Column]:
    """(bits, hashes) of a Bloom filter for a capacity and a false-positive rate."""
    if not 0 < rate < 1:
        raise ValueError("the rate must lie in (0, 1)")
    bits = F.ceil(-capacity * F.log(F.lit(rate)) / F.lit(np.log(2) ** 2))
    return bits, F.greatest(F.lit(1), F.round(bits / capacity * F.lit(float(np.log(2))), 0).cast("int"))


def bloom_positions(user: Column, item: Column, bits: int | Column, hashes: int | Column) -> Column:
    """The bit positions of an item in a user's filter, by double hashing of MD5 numbers."""
    a, b = (digest_number(user.cast("string"), item.cast("string"), F.lit(salt)) for salt in ("a", "b"))
    step = F.struct(a.alias("a"), b.bitwiseOR(F.lit(1)).alias("b"))
    # The two numbers are made once, as a lambda's argument.
    spots = F.transform(F.array(step), lambda h: F.transform(F.sequence(F.lit(0), F.lit(hashes) - 1), lambda i: F.pmod(h["a"] + i * h["b"], F.lit(bits)).cast("int")))
    return F.get(spots, F.lit(0))


def bit_words(bits: Column) -> Column:
    """An aggregate of rows (at, word), a row a word of 64 bits that has any: all words of a set of ``bits`` bits in order."""
    held = F.map_from_entries(F.collect_list(F.struct("at", "word")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.first(bits) - 1) / 64).cast("int")), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0).cast("long")))


def bit_set(words: Column, bit: Column) -> Column:
    """Whether a bit of such a set is set."""
    place = F.get(words, F.floor(bit / 64).cast("int"))
    return F.call_function("getbit", place, F.pmod(bit, F.lit(64)).cast("int")) == 1
