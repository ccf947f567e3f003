"""What is kept between runs: id dictionaries, views for serving, dumps, sketches; and replays over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import digest_digits
from larkspur.operators import candidates, dictionary, dump, features, monitor, online
from larkspur.plans.metrics import vectors
from larkspur.plans.monitoring import FEATURES, served, with_lateness
from larkspur.plans.series import ITEM_SQL
from larkspur.registry import query
from larkspur.sources.shared import new_path, staged
from larkspur.sources.views import CLICKS_EV, SLATES_LI, asked_items, clicks_ev, slates_li
from larkspur.streaming import streams

DAYS = ("2024-01-02", "2024-01-10")


@query(
    "idmap_append",
    f"""WITH {CLICKS_EV}, f AS (SELECT user_id, min(ts) AS t FROM clicks_ev GROUP BY user_id), s AS (SELECT user_id, (t >= TIMESTAMP '{DAYS[0]}')::INTEGER + (t >= TIMESTAMP '{DAYS[1]}')::INTEGER AS version FROM f)
SELECT user_id, row_number() OVER (ORDER BY version, user_id) AS user_idx, version FROM s""",
)
def idmap_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users numbered from the first days, then by two appends of more days; a number once given stays."""
    rows, path = clicks_ev(spark, sf_dir), new_path(spark, "user-map")
    dictionary.create(rows.where(F.col("ts") < F.lit(DAYS[0]).cast("timestamp")), "user_id", path)
    dictionary.append(rows.where(F.col("ts") < F.lit(DAYS[1]).cast("timestamp")), "user_id", path)
    dictionary.append(rows, "user_id", path)
    ends = [dictionary.read(spark, path, v).agg(F.max("idx").alias(f"e{v}")) for v in (0, 1)]
    met = dictionary.read(spark, path).join(F.broadcast(ends[0])).join(F.broadcast(ends[1]))  # one row each
    version = (F.col("idx") > F.coalesce("e0", F.lit(0))).cast("int") + (F.col("idx") > F.coalesce("e1", F.lit(0))).cast("int")
    return met.select(F.col("value").alias("user_id"), F.col("idx").alias("user_idx"), version.alias("version"))


REPLAY_K = 3
REPLAY_SQL = f"""WITH RECURSIVE {SLATES_LI}, req AS (SELECT impression_id AS request, user_id, min(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), impression_id) AS ord FROM slates_li GROUP BY impression_id, user_id),
pop AS (SELECT item_id AS item FROM slates_li WHERE clicked GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT 12),
cand AS (SELECT request, item FROM req, pop UNION SELECT impression_id, item_id FROM slates_li),
pools AS (SELECT user_id, ord, request, list(item ORDER BY ('0x' || substr(md5(user_id::VARCHAR || ':' || item::VARCHAR || ':replay'), 1, 8))::BIGINT DESC, item) AS pool FROM cand JOIN req USING (request) GROUP BY user_id, ord, request),
r AS (
  SELECT user_id, ord, request, pool[1:{REPLAY_K}] AS slate, pool[1:{REPLAY_K}] AS seen, 0::INTEGER AS blocked FROM pools WHERE ord = 1
  UNION ALL
  SELECT user_id, ord, request, slate, list_concat(seen, slate), blocked FROM (
    SELECT p.user_id, p.ord, p.request, r.seen, (len(pool) - len(list_filter(pool, lambda i: NOT list_contains(r.seen, i))))::INTEGER AS blocked,
      CASE WHEN len(list_filter(pool, lambda i: NOT list_contains(r.seen, i))) > 0 THEN list_filter(pool, lambda i: NOT list_contains(r.seen, i))[1:{REPLAY_K}] ELSE pool[1:{REPLAY_K}] END AS slate
    FROM r JOIN pools p ON p.user_id = r.user_id AND p.ord = r.ord + 1)
)
SELECT request, (i - 1)::INTEGER AS position, slate[i] AS item, blocked FROM r, unnest(range(1, len(slate) + 1)) AS t(i)"""


@query("seen_replay", REPLAY_SQL)
def seen_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's requests in order, of the slate's own items and the most clicked ones, with what was served before blocked."""
    asks, clicked = F.collect_set(F.struct("user_id", "ts")).alias("asks"), F.collect_list(F.when(F.col("clicked"), F.col("item_id"))).alias("clicked")
    slates = staged(slates_li(spark, sf_dir, catalogued=False).groupBy("impression_id").agg(asks, F.collect_set("item_id").alias("items"), clicked), "replay-slates")
    counts = slates.select(F.explode("clicked").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    popular = counts.orderBy(F.col("n").desc(), "item").limit(12).agg(F.collect_list("item").alias("popular"))
    sooner = lambda a, b: a["user_id"].eqNullSafe(b["user_id"]) & F.coalesce(a["ts"] < b["ts"], a["ts"].isNotNull() & b["ts"].isNull())
    first = F.filter("asks", lambda b: ~F.exists("asks", lambda a: sooner(a, b)))  # a user's earliest, of a request that has several
    requests = slates.select(F.col("impression_id").alias("request"), F.inline(first), "items")
    return candidates.replay_ranked(requests, lambda rows: _ranked(rows.join(F.broadcast(popular))), REPLAY_K)  # one row


def _ranked(requests: DataFrame) -> DataFrame:
    """Requests with their own and the popular items in the order of a hash of user and item; the popular ones are hashed once a user.

    A hash's hexadecimal digits are in the order of its number; equal ones go to the smaller item.
    """
    place = lambda i: F.struct(digest_digits(F.col("user_id").cast("string"), i.cast("string"), F.lit("replay")).alias("by"), F.bitwise_not(i).alias("item"))
    order = Window.partitionBy("user_id").orderBy("ts", "request")
    top = F.when(F.row_number().over(order) == 1, F.sort_array(F.transform("popular", place), asc=False))
    met = requests.withColumn("top", top).withColumn("top", F.first("top").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = F.sort_array(F.concat("top", F.transform(F.array_except("items", "popular"), place)), asc=False)
    return met.withColumn("pool", F.transform(both, lambda x: F.bitwise_not(x["item"])))


STEP, HALF_LIFE = 500, 2000.0


@query(
    "log_q_stream",
    f"""WITH {CLICKS_EV}, c AS (SELECT impression_id // {STEP} AS step, item_id AS item, count(*) AS n FROM clicks_ev GROUP BY ALL), s AS (SELECT step, sum(n) AS n FROM c GROUP BY step), p AS (SELECT step, n, sum(n) OVER (ORDER BY step) AS upto FROM s),
z AS (SELECT count(DISTINCT item_id) + 1 AS n FROM clicks_ev), own AS (SELECT a.step, a.item, coalesce(sum(b.n * pow(2.0, -((pa.upto - pa.n) - pb.upto)::DOUBLE / {HALF_LIFE})), 0) AS x FROM c a JOIN p pa USING (step) LEFT JOIN (c b JOIN p pb ON pb.step = b.step) ON b.item = a.item AND b.step < a.step GROUP BY a.step, a.item),
w AS (SELECT a.step, coalesce(sum(b.n * pow(2.0, -((a.upto - a.n) - b.upto)::DOUBLE / {HALF_LIFE})), 0) AS x FROM p a LEFT JOIN p b ON b.step < a.step GROUP BY a.step)
SELECT step, item, round(ln((1 + own.x) / ((SELECT n FROM z) + w.x)), 9) AS log_q FROM own JOIN w USING (step)""",
)
def log_q_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling correction of each step's items, from the steps before it, over the items and the reserved index 0."""
    rows = clicks_ev(spark, sf_dir)
    n_items = rows.select(F.count_distinct("item_id")).first()[0] + 1
    told = monitor.log_q(rows.withColumn("step", F.floor(F.col("impression_id") / STEP)), "item_id", "step", HALF_LIFE, n_items)
    return told.withColumn("log_q", F.round("log_q", 9))


END, TTL = "2024-01-20 00:00:00", 2


@query(
    "view_incremental",
    f"""WITH {CLICKS_EV}, {ITEM_SQL}, h AS (SELECT item_id, feature_ts, item_impressions_24h, item_clicks_24h, 0 AS pushed FROM item_hourly WHERE feature_ts <= TIMESTAMP '{END}'),
u AS (SELECT item_id, TIMESTAMP '{END}' AS feature_ts, count(*) AS item_impressions_24h, count(*) FILTER (clicked) AS item_clicks_24h, 1 AS pushed FROM clicks_ev WHERE ts > TIMESTAMP '{END}' - INTERVAL 10 MINUTE AND ts <= TIMESTAMP '{END}' GROUP BY item_id),
l AS (SELECT * FROM (SELECT * FROM h UNION ALL SELECT * FROM u) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY feature_ts DESC, pushed DESC) = 1),
i AS (SELECT DISTINCT item_id FROM clicks_ev WHERE item_id IS NOT NULL), asked AS (SELECT item_id FROM i UNION ALL SELECT item_id + (SELECT max(item_id) - min(item_id) + 1 FROM i) FROM i)
SELECT item_id, CASE WHEN f THEN item_impressions_24h END AS item_impressions_24h, CASE WHEN f THEN item_clicks_24h END AS item_clicks_24h, CASE WHEN f THEN feature_ts END AS feature_ts, f AS found
FROM (SELECT a.item_id, l.* EXCLUDE (item_id), coalesce(l.feature_ts > TIMESTAMP '{END}' - INTERVAL {TTL} HOUR, false) AS f FROM asked a LEFT JOIN l ON l.item_id = a.item_id)""",
)
def view_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item statistics in overlapping ranges, one of them twice, counts of the last minutes pushed by a stream, compacted between."""
    rows = clicks_ev(spark, sf_dir)
    view = online.View(new_path(spark, "item-view"), ("item_id",), ("item_impressions_24h", "item_clicks_24h"), TTL)
    series = staged(features.hourly(rows, features.ITEM).select("item_id", "feature_ts", "item_impressions_24h", "item_clicks_24h"), "view-series")
    day = lambda text: F.lit(text).cast("timestamp")
    for start, end in (("2024-01-05", END), ("2023-12-01", "2024-01-12"), ("2024-01-05", END)):
        online.materialise(view, series, day(start), day(end), day("2024-01-20 00:00:01"))
        if start < "2024":
            online.compact(spark, view)
    late = rows.where((F.col("ts") > day(END) - F.expr("INTERVAL 10 MINUTES")) & (F.col("ts") <= day(END)))
    counts = late.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_impressions_24h"), F.count_if("clicked").alias("item_clicks_24h"))
    stream = streams.replay(counts.select("*", day(END).alias("feature_ts"), day("2024-01-20 00:00:02").alias("created_ts")), "feature_ts", 1)
    stream.writeStream.option("checkpointLocation", new_path(spark, "state-view")).trigger(availableNow=True).foreachBatch(online.push_stream(view)).start().awaitTermination()
    return online.lookup(spark, view, asked_items(spark, sf_dir), day(END))


@query(
    "vector_dump",
    "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first_x, round(embedding[64]::DOUBLE, 6) AS last_x, len(embedding)::INTEGER AS width FROM embeddings",
)
def vector_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings dumped in blocks and read back by row number."""
    path = new_path(spark, "dump")
    dump.write(vectors(spark, sf_dir).withColumnRenamed("item_id", "item"), path)
    asked = dump.manifest(spark, path).select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("position"))
    end = lambda c: F.round(c.cast("double"), 6)
    return dump.read_rows(spark, path, asked).select("position", "id", end(F.element_at("vector", 1)).alias("first_x"), end(F.element_at("vector", -1)).alias("last_x"), F.size("vector").alias("width"))


@query("sketch_drift")
def sketch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the later days against the earlier ones from stored daily sketches alone."""
    daily = staged(monitor.daily_sketches(served(spark, sf_dir), FEATURES), "daily-sketches")
    return monitor.sketch_psi(monitor.merged_sketches(daily, "2024-01-01", "2024-01-15"), monitor.merged_sketches(daily, "2024-01-16", "2024-12-31"))


@query("stream_late_counts", "SELECT count(*) AS arrived, count(*) AS accounted, true AS some_dropped FROM events")
def stream_late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which a tenth come up to twelve days late, against a watermark of seconds: kept and dropped rows add up."""
    late = with_lateness(clicks_ev(spark, sf_dir).select("impression_id", "ts"), 0.1, 12 * 86_400, "impression_id")
    stream = streams.dedupe(streams.replay(late, "ingest_ts", 6), "impression_id").select("impression_id", "ts")
    _, told = streams.accounted(stream, "late-counts")
    return told.select("arrived", (F.col("kept") + F.col("dropped")).alias("accounted"), (F.col("dropped") > 0).alias("some_dropped"))
