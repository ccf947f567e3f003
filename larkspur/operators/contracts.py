"""Expectations on tables as counts of violations, one aggregate a table and kind.

Every function gives rows (contract, violations); ``union`` them for a report.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long(row: DataFrame) -> DataFrame:
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("contract"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in row.columns])))


def rows_where(rows: DataFrame, bad: Mapping[str, Column]) -> DataFrame:
    """How many rows meet each condition, in one pass; a null condition is no violation."""
    return _long(rows.agg(*[F.count_if(c).alias(name) for name, c in bad.items()]))


def totals(rows: DataFrame, bad: Mapping[str, Column]) -> DataFrame:
    """1 where an aggregate condition over all rows holds, else 0."""
    return _long(rows.agg(*[F.when(c, 1).otherwise(0).alias(name) for name, c in bad.items()]))


def duplicate_keys(rows: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """How many keys occur more than once."""
    return _long(rows.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias(name)))


def orphans(rows: DataFrame, name: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """How many rows refer to a parent that doesn't exist; a row without a reference isn't counted."""
    held = parents.select(F.col(parent_key).alias("__p"))
    return _long(rows.where(F.col(key).isNotNull()).select(key).join(held, F.col(key) == F.col("__p"), "left_anti").agg(F.count(F.lit(1)).alias(name)))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
