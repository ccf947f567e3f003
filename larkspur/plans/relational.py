"""The relational surface: grouping sets, pivots, set operations, rank functions, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.registry import query
from larkspur.sources.views import table


@query(
    "pricing_summary",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'2001-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query(
    "nation_revenue",
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
)
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INTEGER AS g1, grouping(l_linestatus)::INTEGER AS g2, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []]
    rows = table(spark, sf_dir, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus")
    return rows.agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count(F.lit(1)).alias("n"))


@query("cube_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("pivot_counts", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS \"view\", count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "purchase"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).count().fillna(0, kinds)


@query("except_items", "SELECT l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def except_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), "l_returnflag")
    return rows.where("l_returnflag = 'R'").select("item_id").subtract(rows.where("l_returnflag = 'A'").select("item_id"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


@query(
    "rank_family",
    "SELECT event_id, rank() OVER w::INTEGER AS r, dense_rank() OVER w::INTEGER AS d, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id)::INTEGER AS q, round(percent_rank() OVER w, 9) AS p, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)",
)
def rank_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = Window.partitionBy("user_id")
    by_value = user.orderBy("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.rank().over(by_value).alias("r"), F.dense_rank().over(by_value).alias("d"), F.ntile(4).over(user.orderBy("value", "event_id")).alias("q"),
        F.round(F.percent_rank().over(by_value), 9).alias("p"), F.lead("event_id").over(user.orderBy("ts", "event_id")).alias("next_event"),
    )


@query("distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY event_type")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.date_trunc("day", "ts")).alias("days"))


@query("approximate_users")
def approximate_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per event type from mergeable HyperLogLog sketches."""
    sketches = table(spark, sf_dir, "events").groupBy("event_type").agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("s"))
    return sketches.select("event_type", F.hll_sketch_estimate("s").alias("users"))


@query("first_click", "SELECT user_id, min(ts) AS first_ts, min_by(event_id, ts) AS first_event FROM events WHERE event_type = 'click' GROUP BY user_id")
def first_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min_by("event_id", "ts").alias("first_event"))


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("hourly_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY date_trunc('hour', ts), event_type")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("sliding_windows", "SELECT s AS start, count(*) AS n FROM (SELECT unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS s FROM events) GROUP BY s")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "24 hours", "1 hour").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
