"""Point-in-time operators: sessions, frames over time, as-of attachment, click histories."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larkspur.functions.columns import seconds
from larkspur.sources.shared import staged

#: Labels of a first key above which its time is cut into ranges, and the length of these.
HOT_ROWS, RANGE_SECONDS = 2_000_000, 3600


def frame(keys: Sequence[str], ts: str, lookback_seconds: int | None = None) -> WindowSpec:
    """Rows of the same keys up to and including ``ts``, all or of the last seconds (both ends count)."""
    start = Window.unboundedPreceding if lookback_seconds is None else -lookback_seconds
    return Window.partitionBy(*keys).orderBy(seconds(F.col(ts))).rangeBetween(start, 0)


def sessionize(events: DataFrame, gap_minutes: float = 30, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """``events`` with session_id ``user#n``; a gap of more than ``gap_minutes`` opens a session.

    Gaps are in whole seconds, a gap of exactly the limit stays inside, and rows of one instant
    share a session because the running sum goes over peers.
    """
    if gap_minutes <= 0:
        raise ValueError("a gap must be positive")
    order = Window.partitionBy(user).orderBy(ts)
    gap = seconds(F.col(ts)) - seconds(F.lag(ts).over(order))
    opens = F.when(gap.isNull() | (gap > gap_minutes * 60), 1).otherwise(0)
    number = F.sum("__opens").over(order)
    return events.withColumn("__opens", opens).withColumn("session_id", F.concat_ws("#", F.col(user).cast("string"), number.cast("string"))).drop("__opens")


def impression_gaps(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Minutes between a user's consecutive impressions (user, ts, gap_minutes); one row per impression but a user's first."""
    shown = events.select("impression_id", user, ts).dropDuplicates(["impression_id"])
    order = Window.partitionBy(user).orderBy(ts, "impression_id")
    gap = (seconds(F.col(ts)) - F.lag(seconds(F.col(ts))).over(order)) / 60.0
    return shown.withColumn("gap_minutes", gap).where("gap_minutes is not null").select(user, ts, "gap_minutes")


@dataclass(frozen=True)
class Series:
    """A feature series: rows that become visible at ``ts`` for equal ``keys``."""

    rows: DataFrame
    keys: tuple[str, ...]
    ts: str
    columns: tuple[str, ...]


def attach_asof(labels: DataFrame, *series: Series, ts: str = "ts", hot_rows: int = HOT_ROWS, range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """``labels`` with each series' columns as last known at ``ts``, features of the same instant included.

    Each column holds its own last non-null value. Series whose first key is the same share one
    union and one exchange: labels and features are sorted by time and the last value is carried
    down, so nothing is multiplied and the cost is that of a sort. A null key finds nothing.

    A first key with more than ``hot_rows`` labels is scanned in segments: its time is cut into
    ranges of ``range_seconds``, the last values of each range are carried to the ranges after it,
    a row a key and range, and labels and features are sorted inside their range alone. A task then
    holds a range of one key, however many rows the key has.
    """
    if hot_rows < 1 or range_seconds < 1:
        raise ValueError("hot_rows and range_seconds must be positive")
    taken = set(labels.columns)
    for s in series:
        clash = taken.intersection(s.columns)
        if clash:
            raise ValueError(f"columns already there: {sorted(clash)}")
        taken.update(s.columns)
    out, counted = labels, {}
    for lead in dict.fromkeys(s.keys[0] for s in series):
        sizes = labels.where(F.col(lead).isNotNull()).groupBy(lead).agg(F.count(F.lit(1)).alias("__n"))
        counted[lead] = staged(sizes.where(F.col("__n") > hot_rows).select(lead), "asof-hot")  # at most labels / hot_rows rows
    for lead, hot in counted.items():
        own = sorted((s for s in series if s.keys[0] == lead), key=lambda s: len(s.keys))
        rows = _union(out, own, ts)
        if hot.isEmpty():
            out = _scanned(rows, own)
        else:
            cold = _scanned(rows.join(hot, lead, "left_anti"), own)
            split = rows.join(hot, lead, "left_semi")
            for s in own:
                split = _scanned_in_ranges(split, s, range_seconds)
            out = cold.unionByName(_labels_of(split, own))
    return out


def _union(labels: DataFrame, series: list[Series], ts: str) -> DataFrame:
    """Labels as structs, and features, in one table of keys and time."""
    keys = list(dict.fromkeys(k for s in series for k in s.keys))
    rows = labels.select(F.struct(*[F.col(f"`{c}`") for c in labels.columns]).alias("__row"), *keys, F.col(ts).alias("__at"), F.lit(1).alias("__label"))
    for s in series:
        rows = rows.unionByName(s.rows.select(*s.keys, F.col(s.ts).alias("__at"), F.lit(0).alias("__label"), *s.columns), allowMissingColumns=True)
    return rows


def _labels_of(rows: DataFrame, series: list[Series]) -> DataFrame:
    return rows.where("__label = 1").select("__row.*", *[c for s in series for c in s.columns])


def _known(s: Series) -> Column:
    out = F.lit(True)
    for k in s.keys:
        out = out & F.col(k).isNotNull()
    return out


def _scanned(rows: DataFrame, series: list[Series]) -> DataFrame:
    """Last values by one window a key."""
    for s in series:
        order = Window.partitionBy(*s.keys).orderBy("__at", "__label").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({c: F.when(_known(s), F.last(c, ignorenulls=True).over(order)) for c in s.columns})
    return _labels_of(rows, series)


def _scanned_in_ranges(rows: DataFrame, s: Series, range_seconds: int) -> DataFrame:
    """Last values inside each key's ranges of time, and of the ranges before where the own range has none yet."""
    rows = rows.withColumn("__range", F.floor(seconds(F.col("__at")) / range_seconds))
    cell = [*s.keys, "__range"]
    lasts = rows.groupBy(*cell).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c) for c in s.columns])
    before = Window.partitionBy(*s.keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*cell, *[F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in s.columns])
    inside = Window.partitionBy(*cell).orderBy("__at", "__label").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in s.columns}).join(carried, cell, "left")
    met = met.withColumns({c: F.when(_known(s), F.coalesce(c, f"__{c}")) for c in s.columns})
    return met.drop("__range", *[f"__{c}" for c in s.columns])


def snapshot_history(snapshots: DataFrame, item_map: DataFrame, user: str = "user_id", history: str = "history") -> DataFrame:
    """(user, snapshot_idx, snapshot_len): the mapped items of a history string, most recent first.

    The string lists items oldest first; items that the map doesn't hold are dropped.
    """
    one = snapshots.where(F.length(F.trim(history)) > 0).groupBy(user).agg(F.max(history).alias("__h"))
    long = one.select(user, F.posexplode(F.split(F.trim("__h"), " +")).alias("__p", "item_id"))
    met = long.join(item_map.select("item_id", "item_idx"), "item_id")
    lists = met.groupBy(user).agg(F.sort_array(F.collect_list(F.struct(F.col("__p"), F.col("item_idx"))), asc=False).alias("__l"))
    return lists.select(user, F.transform("__l", lambda x: x["item_idx"]).alias("snapshot_idx"), F.size("__l").alias("snapshot_len"))


def clicks_before(requests: DataFrame, clicks: DataFrame, cap: int = 50, user: str = "user_id", ts: str = "ts", item: str = "item_idx") -> DataFrame:
    """(impression_id, inwindow_idx, inwindow_len): each request's clicks of earlier seconds, most recent first.

    A user's clicks are put in one order, (second, item), and cut into blocks of ``cap``. A request
    needs only how many of them came before its second, an as-of count: its last ``cap`` clicks then
    lie in the block of the last one and the block before, which stand together in one row. So a
    request meets two blocks, however many clicks its user has.
    """
    if cap < 1:
        raise ValueError("cap must be positive")
    at = seconds(F.col(ts))
    hits = clicks.select(user, at.alias("__s"), F.col(item).alias("__item"))
    numbered = hits.withColumn("__i", F.row_number().over(Window.partitionBy(user).orderBy("__s", "__item")) - 1).withColumn("__block", F.floor(F.col("__i") / cap))
    blocks = numbered.groupBy(user, "__block").agg(F.sort_array(F.collect_list(F.struct("__i", "__item"))).alias("__own"))
    last = F.lag("__own").over(Window.partitionBy(user).orderBy("__block"))
    pairs = blocks.select(user, "__block", F.concat(F.coalesce(last, F.filter("__own", lambda x: F.lit(False))), "__own").alias("__near"))
    count = hits.groupBy(user, "__s").agg(F.count(F.lit(1)).alias("__n")).withColumn("__row", F.lit(None).cast("long"))
    asked = requests.select(user, at.alias("__s"), F.lit(0).cast("long").alias("__n"), F.col("impression_id").alias("__row"))
    order = Window.partitionBy(user).orderBy("__s").rangeBetween(Window.unboundedPreceding, -1)
    before = asked.unionByName(count).withColumn("__k", F.coalesce(F.sum("__n").over(order), F.lit(0)).cast("int")).where("__row is not null")
    met = before.withColumn("__block", F.floor((F.col("__k") - 1) / cap)).join(pairs, [user, "__block"], "left")
    cut = F.reverse(F.filter("__near", lambda x: (x["__i"] < F.col("__k")) & (x["__i"] >= F.col("__k") - cap)))
    return met.select(
        F.col("__row").alias("impression_id"),
        F.when(F.col("__k") > 0, F.transform(cut, lambda x: x["__item"])).otherwise(F.array().cast("array<int>")).alias("inwindow_idx"),
        F.col("__k").alias("inwindow_len"),
    )


def user_history(requests: DataFrame, in_window: DataFrame, snapshots: DataFrame, cap: int = 50, user: str = "user_id") -> DataFrame:
    """One row per request: in-window clicks, then the snapshot, at most ``cap`` items, most recent first."""
    none = F.array().cast("array<int>")
    met = requests.select("impression_id", user).join(in_window, "impression_id", "left").join(snapshots, user, "left")
    items = F.slice(F.concat(F.coalesce("inwindow_idx", none), F.coalesce("snapshot_idx", none)), 1, cap)
    out = met.select("impression_id", items.alias("history_idx"), F.coalesce("inwindow_len", F.lit(0)).alias("inwindow_len"), F.coalesce("snapshot_len", F.lit(0)).alias("snapshot_len"))
    return out.withColumn("history_len", F.size("history_idx")).withColumn("has_history", F.col("history_len") > 0)


def first_seen(rows: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """(keys, first_seen): the earliest instant of each entity."""
    return rows.groupBy(*keys).agg(F.min(ts).alias("first_seen"))


def latest_row(rows: DataFrame, keys: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """Each entity's row that is last in ``order`` among those where the condition holds, by an aggregation without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows if where is None else rows.where(where)
    top = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__top"))
    return top.select(*keys, *[F.col(f"__top.{c}").alias(c) for c in rest])


def pad(array: Column, width: int, fill: Column) -> tuple[Column, Column]:
    """(array cut or filled to ``width``, mask of what was there)."""
    there = F.least(F.size(array), F.lit(width))
    filled = F.slice(F.concat(array, F.array_repeat(fill, width)), 1, width)
    return filled, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i < there)
