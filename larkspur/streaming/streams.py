"""Streaming forms of the batch operators, and a replay source to run them over a table.

What a key keeps is bounded: rows up to a watermark, a window, a fixed-size ring or the sessions of a day.
The state of ``recent_items`` has one such entry for each user, for ever or up to a time to live. Keyed state
in Python is held by bucket of keys.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.functions.columns import bucket_close
from larkspur.sources.shared import new_path, ship

#: How late an event may be before it is dropped.
LATENESS = "30 seconds"
#: Where keyed state with timers lives.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that the state of seen items and of recent items is dealt over: a call of Python is dear, a row in it is not.
SEEN_BUCKETS, RECENT_BUCKETS = 1 << 12, 1 << 11


def replay(rows: DataFrame, order: str, chunks: int = 4) -> DataFrame:
    """A stream over ``rows`` in ranges of ``order``: one stored range per micro-batch, lowest first.

    Ranges are cut at quantiles of ``order`` and written one after another, as arrivals would be,
    each in parallel. A micro-batch takes so many files as there are writing tasks, so a range with
    fewer of them, since some had no row, is filled up with empty files.
    """
    spark, folder = rows.sparkSession, new_path(rows.sparkSession, "replay")
    where = F.unix_micros(F.col(order).cast("timestamp"))
    at = rows.select(where.alias("u")).agg(F.percentile_approx("u", [i / chunks for i in range(1, chunks)], 10_000).alias("q")).first()["q"]
    edges = [None, *sorted(set(at or [])), None]
    files, written = spark.sparkContext.defaultParallelism, 0
    for low, high in zip(edges, edges[1:], strict=False):
        part = F.lit(True)
        part = part if low is None else part & (where >= low)
        part = part if high is None else part & (where < high)
        rows.where(part).coalesce(files).write.mode("append").parquet(folder)
        there = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
        for _ in range(written + files - there):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)
        written += files
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def dedupe(events: DataFrame, ident: str = "event_id", ts: str = "ts") -> DataFrame:
    """Events once each, as long as repeats come within the lateness."""
    return events.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark([ident])


def hourly_counts(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Impressions and clicks per key and closed hour."""
    marked = events.withWatermark(ts, LATENESS).withColumn("feature_ts", bucket_close(F.col(ts)))
    return marked.groupBy(*keys, "feature_ts").agg(F.count(F.lit(1)).alias("impressions"), F.sum(F.col("clicked").cast("long")).alias("clicks"))


def daily_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events of the 24 hours from every full hour."""
    return events.withWatermark(ts, LATENESS).groupBy(F.window(ts, "24 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, start, n) of sessions; instants are floored to seconds, so a gap of exactly the limit stays inside."""
    floored = events.withColumn("__s", F.timestamp_seconds(F.unix_timestamp(ts))).withWatermark("__s", LATENESS)
    grouped = floored.groupBy(user, F.session_window("__s", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(user, F.col("w.start").alias("start"), "n")


def join_context(events: DataFrame, contexts: DataFrame, key: str = "request_id", within: str = "1 hour") -> DataFrame:
    """Events with the context they were served in; both sides' state ends with the watermark."""
    e = events.withWatermark("ts", LATENESS).alias("e")
    c = contexts.withWatermark("served_ts", LATENESS).alias("c")
    on = (F.col(f"e.{key}") == F.col(f"c.{key}")) & (F.col("e.ts") >= F.col("c.served_ts")) & (F.col("e.ts") <= F.col("c.served_ts") + F.expr(f"INTERVAL {within}"))
    return e.join(c, on).select("e.*", *[F.col(f"c.{x}") for x in contexts.columns if x not in (key, *events.columns)])


_RECENT = "user BIGINT, named BOOLEAN, last_items ARRAY<BIGINT>, session_length BIGINT, session_categories BIGINT, version BIGINT"
_RECENT_STATE = (
    "users ARRAY<BIGINT>, named ARRAY<BOOLEAN>, items ARRAY<ARRAY<BIGINT>>, stamps ARRAY<ARRAY<BIGINT>>, starts ARRAY<ARRAY<BIGINT>>, "
    "ends ARRAY<ARRAY<BIGINT>>, counts ARRAY<ARRAY<BIGINT>>, categories ARRAY<ARRAY<ARRAY<STRING>>>, version BIGINT"
)


def recent_items(events: DataFrame, most: int = 50, gap_seconds: int = 1800, late_seconds: int = 86_400, ttl_seconds: int | None = None, buckets: int = RECENT_BUCKETS) -> DataFrame:
    """Per user the last clicked items, most recent first, and the length and categories of the running session.

    State is a ring of the last ``most`` clicks by (time, item), and start, end, count and distinct
    categories of the sessions that a click up to ``late_seconds`` late can still reach; the running
    session is always among them, however many clicks it has. A user's row comes out anew, with a
    higher version, whenever clicks arrive. With ``ttl_seconds`` a user's state ends when the watermark,
    which ``events`` then needs on ts, has passed its newest click by so much; without it, state is
    kept for every user ever seen. Users share the state of their bucket, so that a batch has a call of
    Python a bucket and not a user.
    """
    if ttl_seconds is not None and ttl_seconds <= 0:
        raise ValueError("ttl_seconds must be positive")
    if buckets < 1:
        raise ValueError("buckets must be positive")
    ship(events.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        users, named, *lists, version = state.get if state.exists else ([], [], [], [], [], [], [], [], 0)
        held = dict(zip(zip(named, users, strict=True), zip(*lists, strict=True), strict=True))
        watermark = 0 if ttl_seconds is None else state.getCurrentWatermarkMs()
        until = lambda newest: newest // 1000 + ttl_seconds * 1000
        if ttl_seconds is not None:
            held = {u: x for u, x in held.items() if until(x[1][-1]) + 1 > watermark}
        came: dict[tuple, list[tuple]] = {}
        for b in batches:
            for one, user, *click in zip(*[b[c].tolist() for c in ("named", "user", "us", "known", "item", "category")], strict=True):
                came.setdefault((one, user), []).append(tuple(click))
        # A state that began anew goes on above its predecessor's versions, which the watermark has passed.
        version = max(version + 1, watermark)
        out = []
        for u, clicks in came.items():
            items, stamps, starts, ends, counts, categories = held.get(u, ([], [], [], [], [], []))
            ring = [(t, i is not None, i or 0) for t, i in zip(stamps, items, strict=True)]
            ring = sorted(ring + [c[:3] for c in clicks])[-most:]
            spans = [(s, e, n, set(c)) for s, e, n, c in zip(starts, ends, counts, categories, strict=True)]
            spans = _joined(spans + [(c[0] // 1_000_000, c[0] // 1_000_000, 1, {c[3]}) for c in clicks], gap_seconds)
            spans = [s for s in spans if s[1] >= spans[-1][1] - gap_seconds - late_seconds]
            last = [r[2] if r[1] else None for r in ring]
            held[u] = (last, [r[0] for r in ring], [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], [list(s[3]) for s in spans])
            out.append((u[1], u[0], last[::-1], spans[-1][2], len(spans[-1][3] - {None}), version))
        state.update(([u[1] for u in held], [u[0] for u in held], *map(list, zip(*held.values(), strict=True)), version))
        if ttl_seconds is not None:  # a click that comes after its own time to live ends with the next batch
            state.setTimeoutTimestamp(max(watermark, *[until(x[1][-1]) for x in held.values()]) + 1)
        yield pd.DataFrame(out, columns=["user", "named", "last_items", "session_length", "session_categories", "version"])

    timeout = GroupStateTimeout.NoTimeout if ttl_seconds is None else GroupStateTimeout.EventTimeTimeout
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    clicks = events.where("clicked").select(
        F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), whole("user_id").alias("user"), F.col("user_id").isNotNull().alias("named"), whole("item_id").alias("item"),
        F.col("item_id").isNotNull().alias("known"), "category", *(["ts"] if ttl_seconds else []), F.unix_micros("ts").alias("us"),
    )
    told = clicks.groupBy("bucket").applyInPandasWithState(update, _RECENT, _RECENT_STATE, "update", timeout)
    return told.select(F.when(F.col("named"), F.col("user")).alias("user_id"), "last_items", "session_length", "session_categories", "version")


def _joined(spans: list[tuple[int, int, int, set]], gap_seconds: int) -> list[tuple[int, int, int, set]]:
    """Sessions (start, end, count, categories) in order of time, those within the gap of each other made one."""
    out: list[tuple[int, int, int, set]] = []
    for start, end, n, kinds in sorted(spans, key=lambda s: s[:2]):
        if out and start - out[-1][1] <= gap_seconds:
            s, e, m, known = out[-1]
            known |= kinds
            out[-1] = (s, max(e, end), m + n, known)
        else:
            out.append((start, end, n, set(kinds)))
    return out


#: What showings of a bucket stand as: user, item, which of the two is null (1, 2, or 3: both), instant, as four numbers a row.
_SEEN = "user BIGINT, item BIGINT, none BIGINT, us BIGINT, seen BOOLEAN, version BIGINT"


def unseen(shown: DataFrame, ttl_seconds: int = 7 * 86_400, late_seconds: int = 3600, buckets: int = SEEN_BUCKETS) -> DataFrame:
    """(user_id, item_id, ts, seen, version): whether the user was shown the item within the time to live before.

    One row per instant; of its rows the highest version holds, since a showing that comes late can
    make a later one seen. ``shown`` has a watermark on ts. State is keyed by a bucket of users and
    items, in RocksDB: of each pair the instants of the last ``late_seconds`` and one before them. A
    pair leaves when its last instant is older than both bounds together. A call of Python takes a
    bucket's rows of a batch at once, so calls are bounded by the number of buckets.
    """
    if ttl_seconds < 1 or late_seconds < 0 or buckets < 1:
        raise ValueError("ttl_seconds and buckets must be positive, late_seconds not negative")
    ship(shown.sparkSession)
    shown.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ttl, late = ttl_seconds * 1_000_000, late_seconds * 1_000_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, version = state.get if state.exists else (b"", 0)
        known = np.frombuffer(bytes(held), np.int64).reshape(-1, 4)
        came = np.concatenate([b[["user", "item", "none", "us"]].to_numpy(np.int64) for b in batches])
        every, fresh = np.concatenate((known, came)), np.repeat([False, True], [len(known), len(came)])
        order = np.lexsort(every.T[[3, 2, 1, 0]])
        every = every[order]
        one = np.concatenate(([True], (every[1:] != every[:-1]).any(1)))
        fresh, every = np.logical_or.reduceat(fresh[order], np.flatnonzero(one)), every[one]
        us = every[:, 3]
        after = np.concatenate(([False], (every[1:, :3] == every[:-1, :3]).all(1)))  # a row after another of its user and item
        seen = after & (np.diff(us, prepend=us[0]) <= ttl)
        # A late showing may make the one after it seen, so that one is told anew.
        told = fresh | (after & np.concatenate(([False], fresh[:-1])))
        starts = np.flatnonzero(~after)
        sizes = np.diff(np.append(starts, len(us)))
        last, watermark = us[starts + sizes - 1], state.getCurrentWatermarkMs()
        end = np.maximum((last + ttl + late) // 1000, np.where(np.logical_or.reduceat(fresh, starts), watermark, 0)) + 1
        # Rows come late up to a bound: they ask for the last instant before it and all after it, of pairs that have not ended.
        near = us >= np.repeat(last - late, sizes)
        keep = (near | np.concatenate((near[1:] & after[1:], [False]))) & np.repeat(end > watermark, sizes)
        state.update((every[keep].tobytes(), version + 1))
        state.setTimeoutTimestamp(int(end.max()))
        columns = dict(zip(("user", "item", "none", "us"), every[told].T, strict=True))
        yield pd.DataFrame({**columns, "seen": seen[told], "version": version + 1})

    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    none = F.col("user_id").isNull().cast("long") + 2 * F.col("item_id").isNull().cast("long")
    bucket = F.pmod(F.xxhash64("user_id", "item_id"), F.lit(buckets))
    rows = shown.select(bucket.alias("bucket"), whole("user_id").alias("user"), whole("item_id").alias("item"), none.alias("none"), "ts", F.unix_micros("ts").alias("us"))
    told = rows.groupBy("bucket").applyInPandasWithState(update, _SEEN, "rows BINARY, version BIGINT", "append", GroupStateTimeout.EventTimeTimeout)
    known = [F.when(F.col("none").bitwiseAND(bit) == 0, F.col(c)).alias(f"{c}_id") for c, bit in (("user", 1), ("item", 2))]
    return told.select(*known, F.timestamp_micros("us").alias("ts"), "seen", "version")


def keep_last(stream: DataFrame, table: str, size: int, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last ``size`` rows of the stream in a stored table, batch n's in version=<n mod 2>.

    It is made of the other version, that of batch n - 1, and the batch, so a batch that is run
    again writes the same and two versions are all that is stored.
    """
    schema = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*schema.names)
        if number > 0:
            rows = rows.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{table}/version={(number - 1) % 2}"))
        rows.orderBy(*[F.col(c).desc() for c in order]).limit(size).write.mode("overwrite").parquet(f"{table}/version={number % 2}")

    return merge


class Dropped(StreamingQueryListener):
    """Counts what one query read and what its operators dropped as later than the watermark."""

    def __init__(self) -> None:
        super().__init__()
        self.read, self.dropped, self.ended = {}, {}, set()

    def onQueryStarted(self, event) -> None:  # noqa: N802 (Spark's names)
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        key = (str(p.runId), p.batchId)
        self.read[key] = p.numInputRows
        self.dropped[key] = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))

    def counts(self, run: str, wait_seconds: float = 60.0) -> tuple[int, int]:
        """(rows read, rows dropped) of an ended run, once the listener has heard of its end."""
        until = time.monotonic() + wait_seconds
        while run not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return sum(n for (r, _), n in self.read.items() if r == run), sum(n for (r, _), n in self.dropped.items() if r == run)


def accounted(stream: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """An appending stream's rows, and one row (arrived, kept, dropped) of what became of its input.

    The counts are right for operators that take rows one by one, as ``dedupe`` does with distinct
    ids; a windowed aggregate drops what its tasks have summed already.
    """
    spark = stream.sparkSession
    out, listener = new_path(spark, f"stream-{name}"), Dropped()
    spark.streams.addListener(listener)
    try:
        query = stream.writeStream.outputMode("append").option("checkpointLocation", new_path(spark, f"state-{name}")).trigger(availableNow=True).format("parquet").option("path", out).start()
        query.awaitTermination()
        arrived, dropped = listener.counts(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    rows = spark.read.schema(stream.schema).parquet(out)
    told = rows.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(arrived).cast("long").alias("arrived"), "kept", F.lit(dropped).cast("long").alias("dropped"))
    return rows, told


def drained(stream: DataFrame, mode: str, name: str, key: list[str] | None = None, version: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its result as a table.

    Complete results keep the last batch, appended ones all; updates keep the row of the highest
    version of each key.
    """
    spark: SparkSession = stream.sparkSession
    out, state = new_path(spark, f"stream-{name}"), new_path(spark, f"state-{name}")
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:06d}")
        last.append(number)

    query: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(last):06d}")
    rows = spark.read.schema(stream.schema).option("basePath", out).parquet(out)
    if mode == "update" and key and version:
        rest = [c for c in stream.columns if c not in key]
        top = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("__r"))
        return top.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    return rows.select(*stream.columns)
