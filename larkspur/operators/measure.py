"""Evaluation of scored slates as grouped aggregates: nothing is collected, ties are handled exactly.

A scored row has impression_id, user_id, item_id, clicked and score. What is undefined is null and
left out of means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import dot, ratio
from larkspur.operators.ranges import with_offsets


def tie_break() -> Column:
    """A total order among equal scores that doesn't depend on the rows' order."""
    return F.md5(F.concat_ws(":", F.col("impression_id").cast("string"), F.col("item_id").cast("string")))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, from 1, by score within the slate."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("impression_id").orderBy(F.col("score").desc(), tie_break())))


def slate_auc(rows: DataFrame, keys: Sequence[str] = ("impression_id",)) -> DataFrame:
    """(keys, auc, n, n_clicked): P(clicked above not clicked), ties a half, from mean ranks."""
    order = Window.partitionBy(*keys).orderBy("score")
    peers = F.count(F.lit(1)).over(Window.partitionBy(*keys, "score"))
    mid = F.rank().over(order) + (peers - 1) / 2.0
    per = rows.withColumn("__r", mid).groupBy(*keys).agg(
        F.sum(F.when(F.col("clicked"), F.col("__r"))).alias("__s"), F.count_if("clicked").alias("n_clicked"), F.count(F.lit(1)).alias("n")
    )
    p = F.col("n_clicked")
    return per.withColumn("auc", F.try_divide(F.col("__s") - p * (p + 1) / 2.0, (p * (F.col("n") - p)).cast("double"))).drop("__s")


def ideal_dcg(n: Column, k: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))


def slate_metrics(rows: DataFrame, k: int = 10) -> DataFrame:
    """One row per slate: auc, ndcg, recall, reciprocal_rank, n, n_clicked, flat (all scores equal), user_id."""
    if k < 1:
        raise ValueError("k must be positive")
    slate = Window.partitionBy("impression_id")
    mid = F.rank().over(slate.orderBy("score")) + (F.count(F.lit(1)).over(Window.partitionBy("impression_id", "score")) - 1) / 2.0
    told = ranked(rows).withColumn("__r", mid)
    hit, top = F.col("clicked"), F.col("rank") <= k
    per = told.groupBy("impression_id").agg(
        F.min("user_id").alias("user_id"), F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_clicked"), F.sum(F.when(hit, F.col("__r"))).alias("__s"),
        F.coalesce(F.sum(F.when(hit & top, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("__dcg"), F.count_if(hit & top).alias("__hits"), F.min(F.when(hit, F.col("rank"))).alias("__first"),
        (F.min("score") == F.max("score")).alias("flat"),
    )
    p = F.col("n_clicked")
    some = lambda c: F.when(p > 0, c)
    return per.select(
        "impression_id", "user_id", "n", "n_clicked", "flat", F.try_divide(F.col("__s") - p * (p + 1) / 2.0, (p * (F.col("n") - p)).cast("double")).alias("auc"),
        some(F.col("__dcg") / ideal_dcg(p, k)).alias("ndcg"), some(F.col("__hits") / p).alias("recall"), (F.lit(1.0) / F.col("__first")).alias("reciprocal_rank"),
    )


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of the defined values by weight."""
    return ratio(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def summary(slates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """GAUC with its denominators, mean NDCG, recall and reciprocal rank, and the ceiling that flat slates leave."""
    return slates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("slates"), F.count("auc").alias("scored"), weighted_mean("auc", "n").alias("gauc"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"),
        F.avg("reciprocal_rank").alias("mrr"), (1.0 - 0.5 * F.avg(F.col("flat").cast("double"))).alias("gauc_ceiling"),
    )


def with_cohort(rows: DataFrame) -> DataFrame:
    """(impression_id, cohort): overall, warm or cold user, and warm or cold item by the clicked items; whole slates."""
    per = rows.groupBy("impression_id").agg(F.bool_or("is_cold_user").alias("u"), F.bool_or(F.when(F.col("clicked"), F.col("is_cold_item"))).alias("i"))
    names = F.array_compact(F.array(F.lit("overall"), F.when(F.col("u"), "cold_user").otherwise("warm_user"), F.when(F.col("i"), "cold_item").when(~F.col("i"), "warm_item")))
    return per.select("impression_id", F.explode(names).alias("cohort"))


def global_auc(rows: DataFrame) -> DataFrame:
    """One AUC over all rows: counts per distinct score, then a running count over ranges of scores.

    Scores are range-partitioned; each range is summed by its own window and offset by the ranges
    below it, so no task orders all of them.
    """
    per = rows.groupBy("score").agg(F.count_if("clicked").alias("p"), F.count_if(~F.col("clicked")).alias("q"))
    met = with_offsets(per, ["score"], {"__o": F.col("q")})
    below = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("__b", F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("__o"))
    wins = F.sum(F.col("p") * (F.col("__b") + F.col("q") / 2.0))
    return met.agg(F.try_divide(wins, (F.sum("p") * F.sum("q")).cast("double")).alias("auc"), F.sum(F.col("p") + F.col("q")).alias("n"))


def gini(counts: DataFrame, column: str, catalogue_size: int | None = None) -> DataFrame:
    """(gini, n) of non-negative counts, of the catalogue with zeros where a size is given.

    Equal counts share their ranks, so counts are first grouped by value, and only distinct values are ordered.
    """
    per = counts.groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("m"))
    below = F.coalesce(F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per distinct count
    told = per.withColumn("b", below)
    sums = told.agg(F.sum("m").alias("seen"), F.sum(F.col("x") * F.col("m")).cast("double").alias("sx"), F.sum(F.col("x") * (F.col("m") * F.col("b") + F.col("m") * (F.col("m") + 1) / 2)).alias("six"))
    n = F.col("seen") if catalogue_size is None else F.lit(catalogue_size)
    # Padding zeros move every rank up by their number and add nothing else.
    ranks = F.col("six") + (n - F.col("seen")) * F.col("sx")
    return sums.select(F.try_divide(2 * ranks - (n + 1) * F.col("sx"), n * F.col("sx")).alias("gini"), n.cast("long").alias("n"))


def diversity(rows: DataFrame, vectors: DataFrame, keys: Sequence[str] = ("impression_id",)) -> DataFrame:
    """(keys, diversity): 1 - mean cosine over pairs of known vectors; null below two.

    The sum over pairs is (|sum of units|^2 - number of non-zero units) / 2, so no pair is formed.
    """
    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    units = vectors.select("item_id", F.transform("vector", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("unit"), (norm > 0).cast("int").alias("full"))
    met = rows.select(*keys, "item_id").join(units, "item_id")
    n = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full"))
    sums = met.select(*keys, F.posexplode("unit").alias("p", "x")).groupBy(*keys, "p").agg(F.sum("x").alias("s")).groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    return n.join(sums, list(keys)).select(*keys, (1.0 - F.try_divide((F.col("s2") - F.col("full")) / 2.0, pairs)).alias("diversity"))


def bands(counts: Column, edges: Sequence[int]) -> Column:
    """The label of the band a count falls in; edges belong to the band below."""
    low, out = 0, None
    for e in edges:
        label = str(low) if low == e else f"{low}-{e}"
        out = F.when(counts <= e, label) if out is None else out.when(counts <= e, label)
        low = e + 1
    return out.otherwise(f"{low}+")


def band_labels(edges: Sequence[int]) -> list[str]:
    """The labels that ``bands`` gives, lowest first."""
    lows = (0, *[e + 1 for e in edges])
    return [str(low) if low == e else f"{low}-{e}" for low, e in zip(lows, edges, strict=False)] + [f"{lows[-1]}+"]


def band_users(rows: DataFrame, edges: Sequence[int], pooled: int = 26) -> tuple[DataFrame, DataFrame]:
    """Two scorers per popularity band: the summary, and the paired differences by user behind it.

    ``rows`` are clicked rows (user_id, x, a, b) with the item's clicks and either scorer's hit. The
    summary has (band, n_rows, users, mean_a, mean_b, mean_difference): means over rows, and the mean of
    the per-user differences. Each row also counts in '<pooled' where x is below it, and in 'overall'.
    """
    labels = F.array_compact(F.array(bands(F.col("x"), edges), F.when(F.col("x") < pooled, f"<{pooled}"), F.lit("overall")))
    users = rows.select("user_id", "a", "b", F.explode(labels).alias("band")).groupBy("band", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    users = users.withColumn("difference", (F.col("b") - F.col("a")) / F.col("n"))
    summary = users.groupBy("band").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("users"), (F.sum("a") / F.sum("n")).alias("mean_a"), (F.sum("b") / F.sum("n")).alias("mean_b"), F.avg("difference").alias("mean_difference")
    )
    return summary, users.select("band", "user_id", "difference")


def model_table(cards: DataFrame, value: str, cohorts: Sequence[str]) -> DataFrame:
    """(model, one column a cohort) of report cards (model, cohort, split, k, value).

    Figures of two splits or two cut-offs can't stand in one table: such cards raise when the table is read.
    """
    kinds = cards.agg(F.count_distinct("split", "k").alias("__kinds"))
    wide = cards.groupBy("model").pivot("cohort", list(cohorts)).agg(F.max(value)).join(F.broadcast(kinds))  # one row
    checked = [F.when(F.col("__kinds") > 1, F.raise_error(F.lit("report cards of more than one split or k")).cast("double")).otherwise(F.col(c)).alias(c) for c in cohorts]
    return wide.select("model", *checked)


def require_pools(requests: DataFrame, pools: DataFrame, catalogue: DataFrame, k: int) -> None:
    """Raises where a recall at ``k`` would say nothing: a request with fewer than k candidates, or a catalogue of fewer than k items.

    ``requests`` (request), ``pools`` (request, item), ``catalogue`` (item).
    """
    if k < 1:
        raise ValueError("k must be positive")
    n = catalogue.select("item").where("item is not null").distinct().limit(k).count()
    if n < k:
        raise ValueError(f"the catalogue has {n} items, fewer than k = {k}")
    sizes = requests.select("request").distinct().join(pools.select("request", "item").distinct(), "request", "left").groupBy("request").agg(F.count("item").alias("n"))
    short = sizes.where(F.col("n") < k).agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).first()
    if short["n"]:
        raise ValueError(f"{short['n']} requests have fewer than k = {k} candidates, the least {short['least']}")
