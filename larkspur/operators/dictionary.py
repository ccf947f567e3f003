"""A dictionary of ids that only grows: what has a number keeps it.

It lies in versions beside one another under one path, each a Parquet table (value, idx) of the
values that came with it. A version counts once Spark has marked it as written, so an append that
failed is written over by the next one. Values are numbered from 1 without gaps; 0 is for what
the dictionary doesn't hold. Appends to one path go one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.ranges import numbered
from larkspur.sources.logs import is_built


def _version(path: str, n: int) -> str:
    return f"{path.rstrip('/')}/version={n:06d}"


def versions(spark: SparkSession, path: str) -> int:
    """How many versions are written."""
    n = 0
    while is_built(spark, _version(path, n)):
        n += 1
    return n


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(value, idx) as of a version, by default the last."""
    there = versions(spark, path)
    n = there if version is None else version + 1
    if not 0 < n <= there:
        raise ValueError(f"no such version of {path}")
    return spark.read.parquet(*[_version(path, i) for i in range(n)]).select("value", "idx")


def create(values: DataFrame, column: str, path: str) -> int:
    """Numbers the distinct values in their order, as version 0; refuses where numbers are given already."""
    if versions(values.sparkSession, path):
        raise ValueError(f"{path} has numbers already, and numbering anew would move them; append to it")
    return _write(values.select(F.col(column).alias("value")), path, 0, 0)


def append(values: DataFrame, column: str, path: str) -> int:
    """Numbers what the dictionary doesn't hold yet, above its largest number, in order of the values; how many these were."""
    spark = values.sparkSession
    held = read(spark, path)
    last = held.agg(F.max("idx")).first()[0] or 0
    fresh = values.select(F.col(column).alias("value")).distinct().join(held, "value", "left_anti")
    return _write(fresh, path, versions(spark, path), last)


def _write(values: DataFrame, path: str, version: int, last: int) -> int:
    distinct = values.where("value is not null").distinct()
    rows = numbered(distinct, ["value"], "__n").select("value", (F.col("__n") + 1 + last).cast("long").alias("idx"))
    rows.write.mode("overwrite").parquet(_version(path, version))
    return values.sparkSession.read.parquet(_version(path, version)).count()


def refuse_moves(held: DataFrame, proposed: DataFrame) -> None:
    """Raises if ``proposed`` (value, idx) moves, drops or shares a number of ``held``."""
    both = held.join(proposed.select("value", F.col("idx").alias("to")), "value", "left")
    moved = both.where("`to` is null or `to` <> idx").count()
    shared = proposed.groupBy("idx").agg(F.count_distinct("value").alias("n")).where("n > 1").count()
    if moved or shared:
        raise ValueError(f"{moved} values would move or go and {shared} numbers would be shared")


def uncovered(values: DataFrame, column: str, path: str) -> DataFrame:
    """(value): distinct values that the dictionary doesn't hold."""
    return values.select(F.col(column).alias("value")).where("value is not null").distinct().join(read(values.sparkSession, path), "value", "left_anti")
