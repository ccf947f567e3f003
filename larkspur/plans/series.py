"""Hourly feature series, priors, snapshots and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import digest_number
from larkspur.operators import features, timeline
from larkspur.registry import query
from larkspur.sources.views import CLICKS_EV, asked_items, clicks_ev

#: The driver's tables are small; production keeps features.MIN_PRIOR_IMPRESSIONS.
FLOOR = 100


def _hourly_sql(name: str, keys: str, prefix: str, carried: str = "", age: str = "") -> str:
    span = f"PARTITION BY {keys} ORDER BY epoch(feature_ts)::BIGINT"
    return f"""{name}_1h AS (SELECT {keys}, date_trunc('hour', ts) + INTERVAL 1 HOUR AS feature_ts, count(*) AS {prefix}_impressions_1h, sum(clicked::INTEGER)::BIGINT AS {prefix}_clicks_1h{carried}
  FROM clicks_ev GROUP BY {keys}, date_trunc('hour', ts) + INTERVAL 1 HOUR),
{name} AS (SELECT *,
  (sum({prefix}_impressions_1h) OVER day)::BIGINT AS {prefix}_impressions_24h, (sum({prefix}_clicks_1h) OVER day)::BIGINT AS {prefix}_clicks_24h,
  (sum({prefix}_impressions_1h) OVER far)::BIGINT AS {prefix}_impressions_cum, (sum({prefix}_clicks_1h) OVER far)::BIGINT AS {prefix}_clicks_cum
  {f", (epoch(feature_ts)::BIGINT - min(epoch(feature_ts)::BIGINT) OVER (PARTITION BY {keys})) / 3600.0::DOUBLE AS {age}" if age else ""}
  FROM {name}_1h WINDOW day AS ({span} RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), far AS ({span} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


ITEM_SQL = _hourly_sql("item_hourly", "item_id", "item", ", min(category) AS category", "item_age_hours")
USER_SQL = _hourly_sql("user_hourly", "user_id", "user", "", "user_tenure_hours")
PRIOR_SQL = f"""per_cat AS (SELECT category, feature_ts, sum(item_impressions_1h)::BIGINT AS i, sum(item_clicks_1h)::BIGINT AS c FROM item_hourly GROUP BY category, feature_ts),
per_all AS (SELECT feature_ts, sum(i)::BIGINT AS i, sum(c)::BIGINT AS c FROM per_cat GROUP BY feature_ts),
all_f AS (SELECT feature_ts, sum(i) OVER far AS ai, sum(c) OVER far AS ac, sum(i) OVER day AS ri, sum(c) OVER day AS rc FROM per_all
  WINDOW far AS (ORDER BY epoch(feature_ts)::BIGINT RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), day AS (ORDER BY epoch(feature_ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)),
cat_f AS (SELECT category, feature_ts, sum(i) OVER far AS ci, sum(c) OVER far AS cc, sum(i) OVER day AS di, sum(c) OVER day AS dc FROM per_cat
  WINDOW far AS (PARTITION BY category ORDER BY epoch(feature_ts)::BIGINT RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), day AS (PARTITION BY category ORDER BY epoch(feature_ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)),
prior AS (SELECT category, feature_ts, CASE WHEN ci >= {FLOOR} THEN cc::DOUBLE / ci ELSE ac::DOUBLE / ai END AS cat_expanding_ctr, CASE WHEN di >= {FLOOR} THEN dc::DOUBLE / di ELSE rc::DOUBLE / ri END AS cat_rolling_ctr
  FROM cat_f JOIN all_f USING (feature_ts))"""
ITEM_RATE_SQL = "item_rates AS (SELECT h.*, p.cat_expanding_ctr, (item_clicks_24h + p.cat_expanding_ctr * 20.0::DOUBLE) / (item_impressions_24h + 20.0::DOUBLE) AS item_ctr_smoothed FROM item_hourly h LEFT JOIN prior p USING (category, feature_ts))"
USER_RATE_SQL = """user_all AS (SELECT feature_ts, (sum(c) OVER w)::DOUBLE / (sum(i) OVER w) AS g FROM (SELECT feature_ts, sum(user_impressions_1h) AS i, sum(user_clicks_1h) AS c FROM user_hourly GROUP BY feature_ts)
  WINDOW w AS (ORDER BY epoch(feature_ts)::BIGINT RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
user_rates AS (SELECT h.*, (user_clicks_24h + g * 20.0::DOUBLE) / (user_impressions_24h + 20.0::DOUBLE) AS user_ctr_smoothed FROM user_hourly h LEFT JOIN user_all USING (feature_ts))"""
USER_CAT_SQL = """uc_1h AS (SELECT user_id, category, date_trunc('hour', ts) + INTERVAL 1 HOUR AS feature_ts, count(*) AS i, sum(clicked::INTEGER) AS c FROM clicks_ev GROUP BY user_id, category, date_trunc('hour', ts) + INTERVAL 1 HOUR),
user_cat AS (SELECT user_id, category, feature_ts, (sum(i) OVER pair)::BIGINT AS user_cat_impressions_cum, (sum(c) OVER pair)::BIGINT AS user_cat_clicks_cum,
  ((sum(c) OVER pair) + ((sum(c) OVER own)::DOUBLE / (sum(i) OVER own)) * 5.0::DOUBLE) / ((sum(i) OVER pair) + 5.0::DOUBLE) AS user_cat_affinity FROM uc_1h
  WINDOW pair AS (PARTITION BY user_id, category ORDER BY epoch(feature_ts)::BIGINT RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), own AS (PARTITION BY user_id ORDER BY epoch(feature_ts)::BIGINT RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def item_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = features.hourly(clicks_ev(spark, sf_dir), features.ITEM)
    return features.item_rates(hourly, features.category_prior(hourly, FLOOR))


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.user_rates(features.hourly(clicks_ev(spark, sf_dir), features.USER))


@query("item_hourly", f"WITH {CLICKS_EV}, {ITEM_SQL} SELECT * FROM item_hourly")
def item_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hourly(clicks_ev(spark, sf_dir), features.ITEM)


@query("user_hourly", f"WITH {CLICKS_EV}, {USER_SQL}, {USER_RATE_SQL} SELECT * REPLACE (round(user_ctr_smoothed, 9) AS user_ctr_smoothed) FROM user_rates")
def user_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_series(spark, sf_dir).withColumn("user_ctr_smoothed", F.round("user_ctr_smoothed", 9))


@query("user_category_hourly", f"WITH {CLICKS_EV}, {USER_CAT_SQL} SELECT * REPLACE (round(user_cat_affinity, 9) AS user_cat_affinity) FROM user_cat")
def user_category_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.user_category_affinity(clicks_ev(spark, sf_dir)).withColumn("user_cat_affinity", F.round("user_cat_affinity", 9))


@query("category_prior", f"WITH {CLICKS_EV}, {ITEM_SQL}, {PRIOR_SQL} SELECT category, feature_ts, round(cat_expanding_ctr, 9) AS cat_expanding_ctr, round(cat_rolling_ctr, 9) AS cat_rolling_ctr FROM prior")
def category_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = features.category_prior(features.hourly(clicks_ev(spark, sf_dir), features.ITEM), FLOOR)
    return prior.withColumns({c: F.round(c, 9) for c in ("cat_expanding_ctr", "cat_rolling_ctr")})


@query("item_ctr_smoothed", f"WITH {CLICKS_EV}, {ITEM_SQL}, {PRIOR_SQL}, {ITEM_RATE_SQL} SELECT item_id, feature_ts, round(item_ctr_smoothed, 9) AS item_ctr_smoothed FROM item_rates")
def item_ctr_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_series(spark, sf_dir).select("item_id", "feature_ts", F.round("item_ctr_smoothed", 9).alias("item_ctr_smoothed"))


@query("context_features", "SELECT event_id, hour(ts)::INTEGER AS hour_of_day, (dayofweek(ts) + 1)::INTEGER AS day_of_week FROM events")
def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_ev(spark, sf_dir).select(F.col("impression_id").alias("event_id"), "ts").withColumns(features.context()).drop("ts")


@query(
    "user_tower_block",
    f"""WITH {CLICKS_EV}, {USER_SQL}, t AS (SELECT *, hour(feature_ts) AS h, dayofweek(feature_ts) + 1 AS d FROM user_hourly)
SELECT user_id, feature_ts, round(ln(1 + user_impressions_24h::DOUBLE), 9) AS log_impressions, round(ln(1 + user_clicks_24h::DOUBLE), 9) AS log_clicks, 1.0::DOUBLE AS has_features,
  round(sin(2 * pi() * h / 24), 9) + 0.0 AS hour_sin, round(cos(2 * pi() * h / 24), 9) + 0.0 AS hour_cos, round(sin(2 * pi() * (d - 1) / 7), 9) AS day_sin, round(cos(2 * pi() * (d - 1) / 7), 9) AS day_cos FROM t""",
)
def user_tower_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.hourly(clicks_ev(spark, sf_dir), features.USER).withColumns(features.context("feature_ts")).withColumn("found", F.lit(True))
    block = rows.select("user_id", "feature_ts", *features.tower_block("user_impressions_24h", "user_clicks_24h", "found", "hour_of_day", "day_of_week"))
    rounded = ("log_impressions", "log_clicks", "hour_sin", "hour_cos", "day_sin", "day_cos")
    return block.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in rounded})


LATEST_SQL = "latest AS (SELECT item_id, feature_ts, item_impressions_24h, item_clicks_24h FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY feature_ts DESC) AS rn FROM item_hourly WHERE feature_ts <= TIMESTAMP '2024-01-20') WHERE rn = 1)"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.hourly(clicks_ev(spark, sf_dir), features.ITEM).select("item_id", "feature_ts", "item_impressions_24h", "item_clicks_24h")
    return timeline.latest_row(rows, ["item_id"], ["feature_ts"], F.col("feature_ts") <= F.lit("2024-01-20").cast("timestamp"))


@query("latest_snapshot", f"WITH {CLICKS_EV}, {ITEM_SQL}, {LATEST_SQL} SELECT * FROM latest")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


@query(
    "online_lookup",
    f"""WITH {CLICKS_EV}, {ITEM_SQL}, {LATEST_SQL}, i AS (SELECT DISTINCT item_id FROM clicks_ev WHERE item_id IS NOT NULL), asked AS (SELECT item_id FROM i UNION ALL SELECT item_id + (SELECT max(item_id) - min(item_id) + 1 FROM i) FROM i)
SELECT a.item_id, coalesce(CASE WHEN l.feature_ts > TIMESTAMP '2024-01-20' - INTERVAL 2 HOUR THEN l.item_impressions_24h END, 0) AS item_impressions_24h,
  coalesce(CASE WHEN l.feature_ts > TIMESTAMP '2024-01-20' - INTERVAL 2 HOUR THEN l.item_clicks_24h END, 0) AS item_clicks_24h, coalesce(l.feature_ts > TIMESTAMP '2024-01-20' - INTERVAL 2 HOUR, false) AS found
FROM asked a LEFT JOIN latest l USING (item_id)""",
)
def online_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys asked of a snapshot with a time to live of two hours: zeros and a flag where missing or too old."""
    fresh = F.coalesce(F.col("feature_ts") > F.lit("2024-01-20").cast("timestamp") - F.expr("INTERVAL 2 HOURS"), F.lit(False))
    met = asked_items(spark, sf_dir).join(_latest(spark, sf_dir), "item_id", "left")
    return met.select("item_id", *[F.when(fresh, F.col(c)).otherwise(0).alias(c) for c in ("item_impressions_24h", "item_clicks_24h")], fresh.alias("found"))


@query(
    "derived_features",
    f"""WITH {CLICKS_EV}, {ITEM_SQL}, {PRIOR_SQL}, {ITEM_RATE_SQL}
SELECT item_id, feature_ts, round(coalesce(CASE WHEN item_impressions_24h >= 3 THEN item_ctr_smoothed END, cat_expanding_ctr), 9) AS item_ctr_effective, hour(feature_ts)::INTEGER AS hour_of_day, (dayofweek(feature_ts) + 1)::INTEGER AS day_of_week FROM item_rates""",
)
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("item_impressions_24h") >= 3, F.col("item_ctr_smoothed"))
    out = item_series(spark, sf_dir).select("item_id", "feature_ts", F.round(F.coalesce(own, "cat_expanding_ctr"), 9).alias("item_ctr_effective"))
    return out.withColumns(features.context("feature_ts"))


@query(
    "parity_diff",
    f"""WITH {CLICKS_EV}, {ITEM_SQL}, {LATEST_SQL}, online AS (SELECT item_id, item_clicks_24h + CASE WHEN item_id % 7 = 0 THEN 1 ELSE 0 END AS item_clicks_24h FROM latest WHERE item_id % 11 <> 0)
SELECT count(*) FILTER (o.item_id IS NOT NULL AND abs(o.item_clicks_24h - l.item_clicks_24h) <= 1e-9) AS matched, count(*) FILTER (o.item_id IS NOT NULL AND abs(o.item_clicks_24h - l.item_clicks_24h) > 1e-9) AS mismatched,
  count(*) FILTER (o.item_id IS NULL) AS missing FROM latest l FULL JOIN online o USING (item_id)""",
)
def parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline against online values of one feature: matched, mismatched, missing online."""
    offline = _latest(spark, sf_dir).select("item_id", "item_clicks_24h")
    online = offline.where("item_id % 11 <> 0").select("item_id", (F.col("item_clicks_24h") + (F.col("item_id") % 7 == 0).cast("int")).alias("online"))
    met = offline.join(online, "item_id", "full")
    near = F.abs(F.col("online") - F.col("item_clicks_24h")) <= 1e-9 * F.greatest(F.abs("online"), F.abs("item_clicks_24h"), F.lit(1))
    return met.agg(F.count_if(near).alias("matched"), F.count_if(~near).alias("mismatched"), F.count_if(F.col("online").isNull()).alias("missing"))


@query("first_seen_hours", f"WITH {CLICKS_EV} SELECT item_id, floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(min(ts)))) / 3600)::BIGINT AS age_hours FROM clicks_ev GROUP BY item_id")
def first_seen_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = timeline.first_seen(clicks_ev(spark, sf_dir), ["item_id"])
    end = F.unix_timestamp(F.lit("2024-02-01").cast("timestamp"))
    return seen.select("item_id", F.floor((end - F.unix_timestamp("first_seen")) / 3600).alias("age_hours"))


@query("prior_window_counts", f"WITH {CLICKS_EV} SELECT item_id, count(*) AS clicks FROM clicks_ev WHERE clicked AND ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-23' GROUP BY item_id")
def prior_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clicks_ev(spark, sf_dir).where("clicked and ts >= timestamp'2024-01-16' and ts < timestamp'2024-01-23'")
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("clicks"))


@query(
    "category_index",
    "SELECT p_brand AS category, CASE WHEN n >= 80 THEN row_number() OVER (PARTITION BY n >= 80 ORDER BY p_brand) ELSE 0 END::INTEGER AS category_idx FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)",
)
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values met often enough numbered from 1 in their order; the rare share index 0."""
    counts = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("category")).agg((F.count(F.lit(1)) >= 80).alias("often"))
    number = F.row_number().over(Window.partitionBy("often").orderBy("category"))
    return counts.select("category", F.when(F.col("often"), number).otherwise(0).alias("category_idx"))


@query("holdout_by_user", "SELECT c_custkey AS user_id, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 1000 < 100 AS held_out FROM customer")
def holdout_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return users.withColumn("held_out", digest_number(F.col("user_id").cast("string")) % 1000 < 100)


#: The feature service's contract: a view's keys, the hours its values hold, and the columns that models read from it.
CONTRACT = (
    ("item_stats", ("item_id",), 2, ("item_impressions_24h", "item_clicks_24h", "item_age_hours")), ("user_stats", ("user_id",), 6, ("user_impressions_24h", "user_clicks_24h", "user_tenure_hours")),
    ("user_category_stats", ("user_id", "category"), 24, ("user_cat_impressions_cum", "user_cat_clicks_cum", "user_cat_affinity")),
)


@query(
    "feature_service",
    f"WITH {CLICKS_EV}, {ITEM_SQL}, {USER_SQL}, {USER_CAT_SQL}, l AS (" + " UNION ALL ".join(
        f"SELECT '{view}' AS view, {hours}::INTEGER AS ttl_hours, {len(columns)}::INTEGER AS n_columns, max(feature_ts) AS last_ts FROM {source} WHERE feature_ts <= TIMESTAMP '2024-01-20' GROUP BY {', '.join(keys)}"
        for (view, keys, hours, columns), source in zip(CONTRACT, ("item_hourly", "user_hourly", "user_cat"), strict=True)
    ) + ") SELECT view, ttl_hours, n_columns, count(*) AS entities, count(*) FILTER (last_ts > TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR * ttl_hours) AS fresh FROM l GROUP BY view, ttl_hours, n_columns",
)
def feature_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view of the contract, its columns checked, with how many entities have a row and how many of those are within the view's time to live."""
    events, now = clicks_ev(spark, sf_dir), F.lit("2024-01-20").cast("timestamp")
    views = (features.hourly(events, features.ITEM), features.hourly(events, features.USER), features.user_category_affinity(events))
    out = None
    for (view, keys, hours, columns), rows in zip(CONTRACT, views, strict=True):
        features.require(rows, (*keys, "feature_ts", *columns), view)
        last = rows.where(F.col("feature_ts") <= now).groupBy(*keys).agg(F.max("feature_ts").alias("at"))
        told = last.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("at") > now - F.expr(f"INTERVAL {hours} HOURS")).alias("fresh"))
        told = told.select(F.lit(view).alias("view"), F.lit(hours).alias("ttl_hours"), F.lit(len(columns)).alias("n_columns"), "entities", "fresh")
        out = told if out is None else out.unionByName(told)
    return out
