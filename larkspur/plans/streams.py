"""Streaming forms run over a replay of the event log with late arrivals; results equal the batch forms'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.ingest import SESSION_SQL
from larkspur.plans.monitoring import with_lateness
from larkspur.registry import query
from larkspur.sources.shared import new_path
from larkspur.sources.views import CLICKS_EV, clicks_ev
from larkspur.streaming import streams


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log as it arrives: in order of ingestion, some rows late."""
    return streams.replay(with_lateness(clicks_ev(spark, sf_dir), ident="impression_id"), "ingest_ts")


@query("stream_hourly", f"WITH {CLICKS_EV} SELECT item_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS feature_ts, count(*) AS impressions, sum(clicked::INTEGER)::BIGINT AS clicks FROM clicks_ev GROUP BY item_id, date_trunc('hour', ts)")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.hourly_counts(late_events(spark, sf_dir), ["item_id"]), "complete", "hourly")


@query("stream_daily", "SELECT s AS start, count(*) AS n FROM (SELECT unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS s FROM events) GROUP BY s")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.daily_counts(late_events(spark, sf_dir)), "complete", "daily")


@query("stream_sessions", f"WITH {CLICKS_EV}, {SESSION_SQL} SELECT user_id, date_trunc('second', min(ts)) AS start, count(*) AS n FROM sessions GROUP BY user_id, session_id")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.sessions(late_events(spark, sf_dir)), "complete", "sessions")


@query("stream_dedupe", "SELECT event_id AS impression_id, ts FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event is sent twice within the lateness."""
    rows = with_lateness(clicks_ev(spark, sf_dir).select("impression_id", "ts"), ident="impression_id")
    twice = rows.unionByName(rows.where("impression_id % 10 = 0"))
    stream = streams.replay(twice, "ingest_ts")
    return streams.drained(streams.dedupe(stream, "impression_id"), "append", "dedupe").select("impression_id", "ts")


#: A user without a click for so long leaves the state of recent items.
IDLE_SECONDS = 90 * 86_400


@query(
    "stream_last_items",
    f"WITH {CLICKS_EV}, c AS (SELECT user_id, item_id, ts FROM clicks_ev WHERE clicked) SELECT user_id, list(item_id ORDER BY ts DESC, item_id DESC)[1:50] AS last_items FROM c GROUP BY user_id",
)
def stream_last_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drained(streams.recent_items(late_events(spark, sf_dir).withWatermark("ts", streams.LATENESS), ttl_seconds=IDLE_SECONDS), "update", "recent", ["user_id"], "version")
    return out.select("user_id", "last_items")


@query(
    "stream_running_session",
    f"""WITH {CLICKS_EV}, c AS (SELECT user_id, category, floor(epoch(ts))::BIGINT AS s FROM clicks_ev WHERE clicked),
g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 1800 THEN 1 ELSE 0 END AS opens FROM c), n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS k FROM g),
l AS (SELECT user_id, max(k) AS k FROM n GROUP BY user_id)
SELECT user_id, count(*) AS session_length, count(DISTINCT category) AS session_categories FROM n JOIN l USING (user_id, k) GROUP BY user_id""",
)
def stream_running_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and distinct categories of each user's running session."""
    out = streams.drained(streams.recent_items(late_events(spark, sf_dir).withWatermark("ts", streams.LATENESS), ttl_seconds=IDLE_SECONDS), "update", "running", ["user_id"], "version")
    return out.select("user_id", "session_length", "session_categories")


@query("stream_context_join", "SELECT event_id AS request_id, user_id, 'v' || (user_id % 2)::VARCHAR AS variant FROM events")
def stream_context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and the contexts served a minute before, as two streams."""
    rows = with_lateness(clicks_ev(spark, sf_dir).select(F.col("impression_id").alias("request_id"), "user_id", "ts"), ident="request_id")
    served = rows.select("request_id", (F.col("ts") - F.expr("INTERVAL 1 MINUTE")).alias("served_ts"), F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("variant"), "ingest_ts")
    events, contexts = streams.replay(rows, "ingest_ts").drop("ingest_ts"), streams.replay(served, "ingest_ts").drop("ingest_ts")
    return streams.drained(streams.join_context(events, contexts), "append", "context").select("request_id", "user_id", "variant")


@query("stream_drift_window", "SELECT event_id AS impression_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def stream_drift_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = late_events(spark, sf_dir).select("impression_id", "ts")
    table, numbers = new_path(spark, "drift-window"), []
    merge = streams.keep_last(stream, table, 2000, ["ts", "impression_id"])

    def put(batch: DataFrame, number: int) -> None:
        merge(batch, number)
        numbers.append(number)

    stream.writeStream.option("checkpointLocation", new_path(spark, "state-drift")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{table}/version={max(numbers) % 2}")


@query(
    "stream_seen",
    """WITH s AS (SELECT DISTINCT user_id, (props->>'$.k')::BIGINT AS item_id, ts FROM events)
SELECT user_id, item_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, item_id ORDER BY ts) <= INTERVAL 7 DAY, false) AS seen FROM s""",
)
def stream_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures flagged by whether the user was shown the item in the week before."""
    stream = late_events(spark, sf_dir).withWatermark("ts", streams.LATENESS)
    told = streams.drained(streams.unseen(stream), "append", "seen")
    return told.groupBy("user_id", "item_id", "ts").agg(F.max_by("seen", "version").alias("seen"))
