"""Feature views for serving: one row an entity, fed by ranges of a feature series and by pushes.

A view is a folder with a base table and delta tables, each sorted by a bucket of the entity's keys.
A row counts over another of its entity by (feature_ts, created_ts), wherever they lie, so writing
a range twice, or in another order, changes nothing. Reading merges base and deltas, bucket by
bucket; ``compact`` makes a new base of them. What is older than the view's time to live is found
as missing when it is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.logs import is_built


@dataclass(frozen=True)
class View:
    """``keys``, served ``columns`` and the hours that a value holds; ``path`` is a shared folder."""

    path: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    ttl_hours: int
    buckets: int = 16

    def _part(self, n: int) -> str:
        return f"{self.path.rstrip('/')}/part={n:06d}"

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return rows.select(*self.keys, *self.columns, "feature_ts", "created_ts", bucket.alias("bucket"))


def _parts(spark: SparkSession, view: View) -> list[int]:
    """The parts that count: a base begins anew what lies before it."""
    out, n = [], 0
    while is_built(spark, view._part(n)) or is_built(spark, view._part(n) + "-base"):
        out = [n] if is_built(spark, view._part(n) + "-base") else [*out, n]
        n += 1
    return out


def _next(spark: SparkSession, view: View) -> int:
    n = 0
    while is_built(spark, view._part(n)) or is_built(spark, view._part(n) + "-base"):
        n += 1
    return n


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each entity's row that is last by (feature_ts, created_ts), equal ones by their values."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct("feature_ts", "created_ts", *[c for c in rest if c not in ("feature_ts", "created_ts", "bucket")])
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__top"))
    return top.select(*keys, *[F.col(f"__top.{c}").alias(c) for c in rest])


def push(view: View, rows: DataFrame) -> None:
    """Adds rows with keys, columns, feature_ts and created_ts as a delta: the last of each entity."""
    known = F.lit(True)
    for k in view.keys:
        known = known & F.col(k).isNotNull()
    fresh = latest(view._bucketed(rows.where(known & F.col("feature_ts").isNotNull())), view.keys)
    fresh.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(view._part(_next(rows.sparkSession, view)))


def materialise(view: View, series: DataFrame, start: Column, end: Column, created: Column) -> None:
    """Adds the last row of each entity with feature_ts in [start, end]."""
    push(view, series.where((F.col("feature_ts") >= start) & (F.col("feature_ts") <= end)).withColumn("created_ts", created))


def push_stream(view: View, name: str = "created_ts"):
    """A foreachBatch function that pushes each batch of a stream; a batch that comes twice is one row an entity all the same."""

    def put(batch: DataFrame, number: int) -> None:
        push(view, batch if name == "created_ts" else batch.withColumnRenamed(name, "created_ts"))

    return put


def read(spark: SparkSession, view: View) -> DataFrame:
    """Every entity's last row."""
    parts = _parts(spark, view)
    if not parts:
        raise ValueError(f"nothing was written to {view.path}")
    paths = [view._part(n) + "-base" if i == 0 and is_built(spark, view._part(n) + "-base") else view._part(n) for i, n in enumerate(parts)]
    found = None
    for p in paths:
        one = spark.read.parquet(p).select(*view.keys, *view.columns, "feature_ts", "created_ts", "bucket")
        found = one if found is None else found.unionByName(one)
    return latest(found, view.keys) if len(paths) > 1 else found


def compact(spark: SparkSession, view: View) -> None:
    """Makes a base of all parts; the parts before it no longer count."""
    rows = read(spark, view)
    rows.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(view._part(_next(spark, view)) + "-base")


def lookup(spark: SparkSession, view: View, asked: DataFrame, now: Column) -> DataFrame:
    """The asked keys with their columns, feature_ts and ``found``: false, and nulls, where missing or older than the time to live."""
    met = asked.select(*view.keys).distinct().join(read(spark, view).drop("bucket", "created_ts"), list(view.keys), "left")
    fresh = F.coalesce(F.col("feature_ts") > now - F.expr(f"INTERVAL {view.ttl_hours} HOURS"), F.lit(False))
    return met.select(*view.keys, *[F.when(fresh, F.col(c)).alias(c) for c in (*view.columns, "feature_ts")], fresh.alias("found"))
