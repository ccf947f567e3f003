"""Drift, exposure, serving snapshots and stream preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import digest_number, digest_uniform
from larkspur.operators import features, monitor
from larkspur.plans.series import ITEM_SQL
from larkspur.registry import query
from larkspur.sources.views import CLICKS_EV, asked_items, clicks_ev, table

FEATURES = ("value", "k")
FEAT_SQL = "f AS (SELECT event_id, value, (props->>'$.k')::BIGINT % 17 AS k, ts FROM events), ex AS (SELECT * FROM f WHERE ts < TIMESTAMP '2024-01-16'), ac AS (SELECT * FROM f WHERE ts >= TIMESTAMP '2024-01-16')"
POINTS = [i / 10 for i in range(11)]
EDGE_SQL = "base AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, list_sort(list_distinct(quantile_cont({c}::DOUBLE, {POINTS}))) AS edges FROM ex" for c in FEATURES) + ")"
PSI_SQL = f"""{FEAT_SQL}, {EDGE_SQL}, long AS (SELECT 'e' AS side, 'value' AS feature, value::DOUBLE AS x FROM ex UNION ALL SELECT 'e', 'k', k FROM ex UNION ALL SELECT 'a', 'value', value FROM ac UNION ALL SELECT 'a', 'k', k FROM ac),
binned AS (SELECT side, feature, greatest(0, least(len(list_filter(edges, lambda e: e <= x)) - 1, len(edges) - 2)) AS bin FROM long JOIN base USING (feature)),
n AS (SELECT feature, bin, count(*) FILTER (side = 'e') AS e, count(*) FILTER (side = 'a') AS a FROM binned GROUP BY feature, bin),
s AS (SELECT feature, greatest(e / sum(e) OVER (PARTITION BY feature), 1e-6) AS e, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS a FROM n),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM s GROUP BY feature)"""


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value", (F.get_json_object("props", "$.k").cast("long") % 17).alias("k"), "ts")


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = served(spark, sf_dir)
    return rows.where("ts < timestamp'2024-01-16'"), rows.where("ts >= timestamp'2024-01-16'")


@query("psi_feature", f"WITH {PSI_SQL} SELECT feature, round(psi, 9) AS psi, CASE WHEN psi > 0.25 THEN 'SKEW' WHEN psi > 0.1 THEN 'WATCH' ELSE 'OK' END AS band FROM psi")
def psi_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.psi(*halves(spark, sf_dir), FEATURES).withColumn("psi", F.round("psi", 9))


@query("drift_baseline", f"WITH {FEAT_SQL}, {EDGE_SQL} SELECT feature, list_transform(edges, lambda x: round(x, 6)) AS edges FROM base")
def drift_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.baseline(halves(spark, sf_dir)[0], FEATURES).withColumn("edges", F.transform("edges", lambda x: F.round(x, 6)))


@query("drift_alerts", f"WITH {PSI_SQL}, m AS (SELECT feature AS metric, round(psi, 9) AS value FROM psi) SELECT metric, value, 'page' AS severity FROM m WHERE value > 0.0005")
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = monitor.psi(*halves(spark, sf_dir), FEATURES).select(F.col("feature").alias("metric"), F.round("psi", 9).alias("value"))
    return monitor.alerts(values, [(f, ">", 0.0005, "page") for f in FEATURES])


@query("ks_statistic", f"WITH {FEAT_SQL}, u AS (SELECT value AS x, 1 AS a, 0 AS b FROM ex UNION ALL SELECT value, 0, 1 FROM ac), r AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM u) SELECT round(max(abs(fa - fb)), 9) AS ks FROM r")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.kolmogorov_smirnov(*halves(spark, sf_dir), "value").withColumn("ks", F.round("ks", 9))


@query(
    "skew_report",
    """WITH s AS (SELECT event_type = 'error' AS degraded, lag(ts) OVER w IS NOT NULL AS found, coalesce(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) <= 432000, false) AS fits FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT count(*) AS served, count(*) FILTER (degraded) AS degraded, count(*) FILTER (NOT degraded AND NOT found) AS not_found, count(*) FILTER (NOT degraded AND found AND NOT fits) AS wrong_width, count(*) FILTER (NOT degraded AND found AND fits) AS kept FROM s""",
)
def skew_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served events: a user is found from the second event on, and has all features if the one before is at most five days old."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_type", "value", "ts", F.lag("value").over(before).alias("last"), F.lag("ts").over(before).alias("last_ts"))
    near = F.unix_timestamp("ts") - F.unix_timestamp("last_ts") <= 5 * 86_400
    told = F.array_compact(F.array("value", F.when(near, F.col("last"))))
    return monitor.skew(rows.select((F.col("event_type") == "error").alias("degraded"), F.col("last_ts").isNotNull().alias("found"), told.alias("features")), 2)


@query("drift_window", "SELECT event_id, value FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 5000")
def drift_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 5,000 rows that were served without an error."""
    rows = table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", "value", "ts")
    return monitor.last_rows(rows, 5000, ["ts", "event_id"], least=500).select("event_id", "value")


@query(
    "exposure_windows",
    f"""WITH {CLICKS_EV}, p AS (SELECT item_id, (row_number() OVER (ORDER BY ts, impression_id) - 1) // 1000 AS w FROM clicks_ev), c AS (SELECT w, item_id, count(*) AS x FROM p GROUP BY w, item_id), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY x, item_id) AS i FROM c),
g AS (SELECT w, sum(x)::BIGINT AS exposures, count(*) AS d, sum(i * x) AS ix, (SELECT 2 * count(DISTINCT item_id) FROM clicks_ev) AS z FROM r GROUP BY w)
SELECT w AS "window", exposures, d AS distinct_items, round((2 * (ix + (z - d) * exposures) - (z + 1) * exposures)::DOUBLE / (z * exposures), 9) AS gini_catalogue, round((2 * ix - (d + 1) * exposures)::DOUBLE / (d * exposures), 9) AS gini_observed FROM g WHERE exposures = 1000""",
)
def exposure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 1,000 exposures over a catalogue of the log's items and as many that were never shown."""
    out = monitor.exposure_windows(clicks_ev(spark, sf_dir), 1000, ["ts", "impression_id"], "item_id", asked_items(spark, sf_dir).count())
    return out.withColumns({c: F.round(c, 9) for c in ("gini_catalogue", "gini_observed")})


@query("popular_topn", f"WITH {CLICKS_EV}, {ITEM_SQL}, l AS (SELECT item_id, max_by(item_clicks_24h, feature_ts) AS clicks FROM item_hourly GROUP BY item_id) SELECT item_id, clicks FROM l ORDER BY clicks DESC, item_id LIMIT 20")
def popular_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.hourly(clicks_ev(spark, sf_dir), features.ITEM)
    last = rows.groupBy("item_id").agg(F.max_by("item_clicks_24h", "feature_ts").alias("clicks"))
    return last.orderBy(F.col("clicks").desc(), "item_id").limit(20)


@query("lateness_inject", "WITH u AS (SELECT event_id, ts, ('0x' || substr(md5(event_id::VARCHAR || ':late'), 1, 8))::BIGINT AS a, ('0x' || substr(md5(event_id::VARCHAR || ':by'), 1, 8))::BIGINT AS b FROM events) SELECT event_id, ts, ts + to_seconds(CASE WHEN a / 4294967296.0::DOUBLE < 0.02 THEN 1 + b % 30 ELSE 0 END) AS ingest_ts FROM u")
def lateness_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lateness(table(spark, sf_dir, "events").select("event_id", "ts"))


def with_lateness(rows: DataFrame, share: float = 0.02, most_seconds: int = 30, ident: str = "event_id") -> DataFrame:
    """``rows`` with ingest_ts: a share of them arrives 1 to ``most_seconds`` late, by a hash; nothing is lost."""
    if not 0 <= share <= 1 or most_seconds < 1:
        raise ValueError("a share in [0, 1] and a positive delay")
    key = F.col(ident).cast("string")
    delay = F.when(digest_uniform(key, F.lit("late")) < share, 1 + digest_number(key, F.lit("by")) % most_seconds).otherwise(0)
    return rows.withColumn("ingest_ts", F.timestamp_add("SECOND", delay.cast("int"), F.col("ts")))


@query("explode_served_slate", "SELECT o_orderkey AS request_id, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS position, l_partkey AS item_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def explode_served_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per item of a served slate, from its context's list of items."""
    context = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return context.select("request_id", F.posexplode(F.transform("items", lambda x: x["l_partkey"])).alias("position", "item_id"))


@query("decayed_frequency", "WITH r AS (SELECT (props->>'$.k')::BIGINT AS item_id, event_id // 1000 AS step FROM events) SELECT item_id, round(sum(exp(ln(0.9) * ((SELECT max(step) FROM r) - step))), 9) AS frequency FROM r GROUP BY item_id")
def decayed_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clicks_ev(spark, sf_dir).select("item_id", F.floor(F.col("impression_id") / 1000).alias("step"))
    return monitor.decayed_frequency(rows, "item_id", "step", 0.9).withColumn("frequency", F.round("frequency", 9))


@query("vocabulary_check", "WITH a AS (SELECT DISTINCT p_brand AS category FROM part), b AS (SELECT DISTINCT p_brand AS category FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT (SELECT count(*) FROM a) AS catalogue, (SELECT count(*) FROM b) AS served, (SELECT count(*) FROM b WHERE category NOT IN (SELECT category FROM a)) AS unknown")
def vocabulary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the catalogue against those met in slates."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("category"))
    met = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("category").distinct().withColumn("s", F.lit(True))
    both = part.select("category").distinct().withColumn("c", F.lit(True)).join(met, "category", "full")
    return both.agg(F.count("c").alias("catalogue"), F.count("s").alias("served"), F.count_if(F.col("c").isNull()).alias("unknown"))


@query("seeded_sample", "SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 200")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 rows in hash order: the same in every run."""
    rows = table(spark, sf_dir, "events").select("event_id")
    return rows.orderBy(F.md5(F.col("event_id").cast("string")), "event_id").limit(200)


@query("canonical_order", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id::VARCHAR || ':' || event_id::VARCHAR), event_id)::INTEGER AS place FROM events")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"))), "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(order).alias("place"))
