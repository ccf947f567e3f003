"""The driver tables and the canonical views over them, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; timestamps without a zone are taken in the session's."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def clicks_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shown item per event: impression_id, user_id, item_id, category, clicked, ts."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("impression_id"), "user_id", k.alias("item_id"), (k % 8).cast("string").alias("category"), (F.col("event_type") == "click").alias("clicked"), "ts"
    )


def asked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id) of every item of the click log, and as many keys above the largest that it doesn't hold."""
    items = clicks_ev(spark, sf_dir).where("item_id is not null").select("item_id").distinct()
    ends = items.agg((F.max("item_id") - F.min("item_id") + 1).alias("by"))
    return items.unionByName(items.join(F.broadcast(ends)).select((F.col("item_id") + F.col("by")).alias("item_id")))  # one row


def slates_li(spark: SparkSession, sf_dir: str, catalogued: bool = True) -> DataFrame:
    """One row per (order, part): slates of several items that share one timestamp, dealt by impression_id.

    A slate's lines meet in one task from the join on, so what is grouped by impression later isn't
    shuffled again. With ``catalogued`` false the same rows come without category and subcategory.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    kinds = ["p_brand", "p_type"] if catalogued else ["kind"]  # parts of one key are told apart by a hash of both
    parts = table(spark, sf_dir, "part").withColumn("kind", F.xxhash64(F.coalesce("p_brand", F.lit("\1")), F.lit("\0"), F.coalesce("p_type", F.lit("\1")))).select("p_partkey", *kinds)
    met = dealt(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), lines.count(), "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shown = met.groupBy("l_orderkey", "o_custkey", "l_partkey", *kinds, "o_orderdate").agg(F.bool_or(F.col("l_returnflag") == "R").alias("clicked"), (F.min("l_linenumber") - 1).alias("slot"))
    of_item = [F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory")] if catalogued else []
    return shown.select(F.col("l_orderkey").alias("impression_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), *of_item, "clicked", "slot", F.col("o_orderdate").alias("ts"))


def behaviours(slates: DataFrame) -> DataFrame:
    """Slates written the way raw logs hold them: a string of item-click pairs per impression."""
    pair = F.concat(F.col("item_id").cast("string"), F.lit("-"), F.col("clicked").cast("int").cast("string"))
    rows = slates.groupBy("impression_id", "user_id", "ts").agg(F.sort_array(F.collect_list(F.struct("slot", "item_id", pair.alias("pair")))).alias("shown"))
    return rows.select("impression_id", "user_id", F.date_format("ts", "M/d/yyyy h:mm:ss a").alias("time"), F.array_join(F.transform("shown", lambda x: x["pair"]), " ").alias("impressions"))


CLICKS_EV = """clicks_ev AS (
  SELECT event_id AS impression_id, user_id, (props->>'$.k')::BIGINT AS item_id, ((props->>'$.k')::BIGINT % 8)::VARCHAR AS category, event_type = 'click' AS clicked, ts FROM events
)"""
SLATES_LI = """slates_li AS (
  SELECT l_orderkey AS impression_id, o_custkey AS user_id, l_partkey AS item_id, p_brand AS category, p_type AS subcategory, bool_or(l_returnflag = 'R') AS clicked,
    min(l_linenumber) - 1 AS slot, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey, o_custkey, l_partkey, p_brand, p_type, o_orderdate
)"""
