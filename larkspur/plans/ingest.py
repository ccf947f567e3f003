"""Scans, parsing, id maps, sessions and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import timeline, transform
from larkspur.operators.ranges import quantiles
from larkspur.registry import query
from larkspur.sources import logs
from larkspur.sources.views import CLICKS_EV, SLATES_LI, behaviours, clicks_ev, slates_li, table

SESSION_SQL = """gapped AS (SELECT *, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM clicks_ev),
sessions AS (SELECT * EXCLUDE gap, user_id::VARCHAR || '#' || (sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT::VARCHAR AS session_id FROM gapped)"""
GAPS_SQL = """gaps AS (SELECT user_id, ts, gap_minutes FROM (
  SELECT user_id, ts, (floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, impression_id)) / 60.0::DOUBLE AS gap_minutes FROM clicks_ev) WHERE gap_minutes IS NOT NULL)"""


@query("scan_parquet", "SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click' AND value > 50")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click' and value > 50").select("event_id", "user_id", "ts", "value")


@query("catalogue_dedupe", "SELECT p_partkey AS item_id, min(p_brand) AS category, min(p_type) AS subcategory FROM part GROUP BY ALL")
def catalogue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory"))
    return logs.dedupe_catalogue([part.where("item_id % 3 < 2"), part.where("item_id % 3 > 0")])


@query("union_splits", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F'")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return orders.where("o_orderstatus = 'F'").unionByName(orders.where("o_orderstatus <> 'F'")).drop("o_orderstatus")


@query("catalogue_overlap", "SELECT l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def catalogue_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), "l_returnflag")
    return lines.where("l_returnflag = 'R'").select("item_id").intersect(lines.where("l_returnflag = 'N'").select("item_id"))


@query(
    "parse_timestamp",
    "SELECT event_id, strptime(strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p'), '%m/%d/%Y %I:%M:%S %p') AS parsed, date_trunc('day', ts)::DATE AS dt FROM events",
)
def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", logs.TIME_FORMAT).alias("time"))
    return told.select("event_id", F.to_timestamp("time", logs.TIME_FORMAT).alias("parsed")).withColumn("dt", F.to_date("parsed"))


@query("explode_impressions", f"WITH {SLATES_LI} SELECT impression_id, user_id, item_id::VARCHAR AS item_id, clicked, (row_number() OVER (PARTITION BY impression_id ORDER BY slot, item_id) - 1)::INTEGER AS slot, ts FROM slates_li")
def explode_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.to_events(behaviours(slates_li(spark, sf_dir)))


@query(
    "event_json_roundtrip",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def event_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return logs.from_json_lines(logs.to_json_lines(rows), rows.schema)


@query("json_log_scan", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = table(spark, sf_dir, "events").select(F.concat(F.lit("INFO served "), F.to_json(F.struct("event_id", "props"))).alias("value"))
    noise = spark.range(3).select(F.lit("no record here").alias("value"))
    found = logs.from_json_lines(noisy.unionByName(noise), "event_id BIGINT, props STRING")
    return found.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("id_maps", f"WITH {CLICKS_EV} SELECT user_id, (dense_rank() OVER (ORDER BY user_id))::INTEGER AS user_idx FROM (SELECT DISTINCT user_id FROM clicks_ev)")
def id_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.dense_ids(clicks_ev(spark, sf_dir), "user_id", "user_idx")


def _early(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_ev(spark, sf_dir).where("ts < timestamp'2024-01-02'")


@query("idmap_uncovered", f"WITH {CLICKS_EV} SELECT DISTINCT user_id FROM clicks_ev WHERE user_id NOT IN (SELECT user_id FROM clicks_ev WHERE ts < TIMESTAMP '2024-01-02')")
def idmap_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.uncovered(clicks_ev(spark, sf_dir), _early(spark, sf_dir).select("user_id").distinct(), "user_id")


@query("idmap_checks", f"WITH {CLICKS_EV}, u AS (SELECT DISTINCT user_id FROM clicks_ev) SELECT count(*) AS n, count(*) AS n_distinct, 1 AS low, count(*)::INTEGER AS high, true AS dense FROM u")
def idmap_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = transform.dense_ids(clicks_ev(spark, sf_dir), "user_id", "user_idx")
    out = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_idx").alias("n_distinct"), F.min("user_idx").alias("low"), F.max("user_idx").alias("high"))
    return out.withColumn("dense", (F.col("n") == F.col("n_distinct")) & (F.col("low") == 1) & (F.col("high") == F.col("n")))


def silver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = clicks_ev(spark, sf_dir).drop("category")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory"))
    seen = _early(spark, sf_dir)
    return transform.silver(events, part, transform.dense_ids(seen, "item_id", "item_idx"), transform.dense_ids(seen, "user_id", "user_idx"))


SILVER_SQL = f"""WITH {CLICKS_EV}, {SESSION_SQL},
im AS (SELECT item_id, row_number() OVER (ORDER BY item_id)::INTEGER AS item_idx FROM (SELECT DISTINCT item_id FROM clicks_ev WHERE ts < TIMESTAMP '2024-01-02')),
um AS (SELECT user_id, row_number() OVER (ORDER BY user_id)::INTEGER AS user_idx FROM (SELECT DISTINCT user_id FROM clicks_ev WHERE ts < TIMESTAMP '2024-01-02'))
SELECT impression_id, user_id, item_id, clicked, ts, p_brand AS category, p_type AS subcategory, coalesce(item_idx, 0) AS item_idx, coalesce(user_idx, 0) AS user_idx, ts::DATE AS dt, session_id
FROM sessions LEFT JOIN part ON item_id = p_partkey LEFT JOIN im USING (item_id) LEFT JOIN um USING (user_id)"""


@query("silver_join", SILVER_SQL)
def silver_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_rows(spark, sf_dir)


@query("sessionize", f"WITH {CLICKS_EV}, {SESSION_SQL} SELECT impression_id, user_id, session_id FROM sessions")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sessionize(clicks_ev(spark, sf_dir)).select("impression_id", "user_id", "session_id")


@query("impression_gaps", f"WITH {CLICKS_EV}, {GAPS_SQL} SELECT user_id, ts, gap_minutes FROM gaps")
def impression_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.impression_gaps(clicks_ev(spark, sf_dir))


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
LIMITS = (5, 10, 15, 20, 30, 45, 60, 120, 240, 720, 1440)


@query("gap_quantiles", f"WITH {CLICKS_EV}, {GAPS_SQL} " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(gap_minutes, {q}), 6) AS gap_minutes FROM gaps" for q in QUANTILES))
def gap_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = timeline.impression_gaps(clicks_ev(spark, sf_dir)).select(F.lit(0).alias("feature"), F.col("gap_minutes").alias("x"))
    row = quantiles(gaps, QUANTILES).select(F.col("values").alias("v"))
    return row.select(F.explode(F.arrays_zip(F.array(*map(F.lit, QUANTILES)).alias("q"), "v")).alias("z")).select("z.q", F.round("z.v", 6).alias("gap_minutes"))


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gaps up to each limit: one pass, one conditional mean a limit."""
    row = timeline.impression_gaps(clicks_ev(spark, sf_dir)).agg(*[F.avg((F.col("gap_minutes") <= m).cast("double")).alias(f"m{m}") for m in LIMITS])
    pairs = [F.struct(F.lit(m).alias("minutes"), F.col(f"m{m}").alias("kept")) for m in LIMITS]
    return row.select(F.inline(F.array(*pairs)))


RETENTION_SQL = f"kept AS (SELECT m AS minutes, avg((gap_minutes <= m)::INTEGER::DOUBLE) AS kept FROM gaps, (VALUES {', '.join(f'({m})' for m in LIMITS)}) AS t(m) GROUP BY m)"


@query("gap_retention", f"WITH {CLICKS_EV}, {GAPS_SQL}, {RETENTION_SQL} SELECT minutes, round(kept, 9) AS kept FROM kept")
def gap_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retention(spark, sf_dir).select("minutes", F.round("kept", 9).alias("kept"))


@query(
    "gap_density",
    f"""WITH {CLICKS_EV}, {GAPS_SQL}, {RETENTION_SQL}, d AS (SELECT minutes, (kept - coalesce(lag(kept) OVER w, 0)) / (minutes - coalesce(lag(minutes) OVER w, 0)) AS density FROM kept WINDOW w AS (ORDER BY minutes))
SELECT minutes, round(density, 9) AS density, round(lag(density) OVER (ORDER BY minutes) / nullif(density, 0), 6) AS fall, coalesce(lag(density) OVER (ORDER BY minutes) >= 2 * density, false) AS knee FROM d""",
)
def gap_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps per minute between limits; a knee is where the density falls to half or less. A row per limit."""
    from pyspark.sql import Window

    w = Window.orderBy("minutes")
    kept = _retention(spark, sf_dir)
    share = (F.col("kept") - F.coalesce(F.lag("kept").over(w), F.lit(0.0))) / (F.col("minutes") - F.coalesce(F.lag("minutes").over(w), F.lit(0)))
    out = kept.select("minutes", share.alias("d"))
    before = F.lag("d").over(w)
    return out.select("minutes", F.round("d", 9).alias("density"), F.round(F.try_divide(before, F.col("d")), 6).alias("fall"), F.coalesce(before >= 2 * F.col("d"), F.lit(False)).alias("knee"))


@query("orphan_clicks", f"WITH {CLICKS_EV} SELECT impression_id, item_id FROM clicks_ev WHERE clicked AND item_id NOT IN (SELECT p_partkey FROM part)")
def orphan_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return clicks_ev(spark, sf_dir).where("clicked").join(part, "item_id", "left_anti").select("impression_id", "item_id")


@query(
    "data_contracts",
    f"""WITH {SLATES_LI}, s AS (SELECT impression_id, count(*) AS n FROM slates_li GROUP BY impression_id)
SELECT 'null_keys' AS contract, count(*) FILTER (impression_id IS NULL OR user_id IS NULL OR item_id IS NULL)::BIGINT AS violations FROM slates_li
UNION ALL SELECT 'duplicate_keys', (SELECT count(*) FROM (SELECT 1 FROM slates_li GROUP BY impression_id, item_id HAVING count(*) > 1))
UNION ALL SELECT 'click_rate', CASE WHEN avg(clicked::INTEGER) BETWEEN 0.01 AND 0.5 THEN 0 ELSE 1 END FROM slates_li
UNION ALL SELECT 'short_slates', count(*) FILTER (n < 2) FROM s
UNION ALL SELECT 'straddling_slates', (SELECT count(*) FROM (SELECT 1 FROM slates_li GROUP BY impression_id HAVING min(ts) < max(ts)))
UNION ALL SELECT 'uncatalogued_items', count(*) FILTER (category IS NULL) FROM slates_li""",
)
def data_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each expectation: one pass over the slates, summed by key, by slate and then together."""
    rows = slates_li(spark, sf_dir)
    none = F.col("impression_id").isNull() | F.col("user_id").isNull() | F.col("item_id").isNull()
    keys = rows.groupBy("impression_id", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(none).alias("null_keys"), F.count_if("clicked").alias("hit"), F.count("clicked").alias("told"),
        F.count_if(F.col("category").isNull()).alias("uncatalogued_items"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    added = ("n", "null_keys", "hit", "told", "uncatalogued_items")
    slates = keys.groupBy("impression_id").agg(*[F.sum(c).alias(c) for c in added], F.count_if(F.col("n") > 1).alias("duplicate_keys"), (F.min("first") < F.max("last")).alias("wide"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    whole = slates.agg(
        total("null_keys"), total("duplicate_keys"), F.when(F.try_divide(F.sum("hit"), F.sum("told")).between(0.01, 0.5), 0).otherwise(1).alias("click_rate"),
        F.count_if(F.col("n") < 2).alias("short_slates"), F.count_if("wide").alias("straddling_slates"), total("uncatalogued_items"),
    )
    return whole.select(F.inline(F.array(*[F.struct(F.lit(c).alias("contract"), F.col(c).cast("long").alias("violations")) for c in whole.columns])))
