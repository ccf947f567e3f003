"""Global order without a global task: ranges numbered apart, each offset by the ranges before it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.shared import staged


def with_offsets(rows: DataFrame, order: Sequence[str], sums: Mapping[str, Column], totals: bool = False) -> DataFrame:
    """``rows`` with ``part``, the number of their range of ``order``, and per sum what the ranges before add up to.

    Ranges are stored before they are summed: both uses then see the same ranges, whatever the
    adaptive planner merges and whichever executor is lost. The sums have a row a range, so the
    window over them and the broadcast are bounded by the number of shuffle partitions. With
    ``totals`` each sum over all rows comes as ``<name>_total``.
    """
    ranged = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums]
    if totals:
        told += [F.sum(n).over(Window.partitionBy()).alias(f"{n}_total") for n in sums]
    return ranged.join(F.broadcast(sizes.select("part", *told)), "part")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """``rows`` with their place, from 0, in a total order."""
    ranged = with_offsets(rows, order, {"__before": F.lit(1)})
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn(name, F.col("__before") + place).drop("part", "__before")


def quantiles(long: DataFrame, points: Sequence[float], key: str = "feature", value: str = "x") -> DataFrame:
    """(key, values): the exact interpolated quantiles of each key's values, an array in the order of ``points``.

    Equal values are counted together. Ranges of (key, value) are ordered apart and offset by the
    ranges before them, so that each distinct value knows the places it takes in its key's order;
    the few places asked for are then picked by one aggregation. No task holds all values.
    """
    counts = long.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("__n"))
    return quantiles_of(counts, points, key, value)


def quantiles_of(counts: DataFrame, points: Sequence[float], key: str = "feature", value: str = "x") -> DataFrame:
    """As ``quantiles``, of distinct values with how often each is met, ``__n``."""
    met = with_offsets(counts, [key, value], {"__before": F.col("__n")})
    run = Window.partitionBy("part").orderBy(key, value).rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("__end", F.col("__before") + F.sum("__n").over(run)).withColumn("__start", F.col("__end") - F.col("__n"))
    sizes = met.groupBy(key).agg(F.min("__start").alias("__first"), F.max("__end").alias("__last"))
    met = met.join(F.broadcast(sizes), key)  # a row a key
    at = lambda q: F.lit(float(q)) * (F.col("__last") - F.col("__first") - 1)
    holds = lambda rank: (rank >= F.col("__start") - F.col("__first")) & (rank < F.col("__end") - F.col("__first"))
    found = [F.max(F.when(holds(r(at(q))), F.col(value))).alias(f"__{n}{i}") for i, q in enumerate(points) for n, r in (("l", F.floor), ("h", F.ceil))]
    picked = met.groupBy(key).agg(F.max(F.col("__last") - F.col("__first") - 1).alias("__top"), *found)

    def between(i: int, q: float) -> Column:
        place, low, high = F.lit(float(q)) * F.col("__top"), F.col(f"__l{i}"), F.col(f"__h{i}")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return picked.select(key, F.array(*[between(i, q) for i, q in enumerate(points)]).alias("values"))
