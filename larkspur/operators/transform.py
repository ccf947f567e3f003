"""From events to the joined, sessionised table: id maps, catalogue join, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ranges import numbered
from larkspur.operators.timeline import sessionize

#: Index of what no map holds.
OOV = 0


def dense_ids(values: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): distinct values numbered from 1 in their order.

    Values are numbered by ranges, so no task sees all of them.
    """
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    return numbered(distinct, [column], "__n").select(column, (F.col("__n") + 1).cast("int").alias(name))


def uncovered(events: DataFrame, id_map: DataFrame, column: str) -> DataFrame:
    """Distinct ids of events that the map doesn't hold."""
    return events.select(column).distinct().join(id_map.select(column), column, "left_anti")


def silver(events: DataFrame, catalogue: DataFrame, item_map: DataFrame, user_map: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Events with catalogue columns, dense ids (0 where unknown), sessions and their date."""
    out = events.join(catalogue, "item_id", "left").join(item_map, "item_id", "left").join(user_map, "user_id", "left")
    out = out.withColumns({"item_idx": F.coalesce("item_idx", F.lit(OOV)), "user_idx": F.coalesce("user_idx", F.lit(OOV)), "dt": F.to_date("ts")})
    return sessionize(out, gap_minutes)


def slate_negatives(events: DataFrame, cap: int = 20) -> DataFrame:
    """(impression_id, neg_idx, neg_len): items shown but not clicked, in hash order, so a smaller cap is a prefix."""
    if cap < 1:
        raise ValueError("cap must be positive")
    order = F.md5(F.concat_ws(":", F.col("impression_id").cast("string"), F.col("item_id").cast("string")))
    lists = events.where(~F.col("clicked")).groupBy("impression_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("h"), F.col("item_idx")))).alias("__l"))
    items = F.slice(F.transform("__l", lambda x: x["item_idx"]), 1, cap)
    return lists.select("impression_id", items.alias("neg_idx"), F.size(items).alias("neg_len"))
