"""Hourly feature series, priors and smoothed rates, compiled from one description."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import DAY_SECONDS, bucket_close, cyclic, seconds, shrunk_rate
from larkspur.operators.timeline import frame

#: A category with fewer impressions so far takes the global rate.
MIN_PRIOR_IMPRESSIONS = 1000


@dataclass(frozen=True)
class HourlyView:
    """Counts per entity and closed hour. ``rolling``: also over the last day; ``age``: name of hours since first seen."""

    keys: tuple[str, ...]
    prefix: str
    rolling: bool = True
    cumulative: bool = True
    age: str | None = None
    carried: tuple[str, ...] = ()


ITEM = HourlyView(("item_id",), "item", age="item_age_hours", carried=("category",))
USER = HourlyView(("user_id",), "user", age="user_tenure_hours")
USER_CATEGORY = HourlyView(("user_id", "category"), "user_cat", rolling=False)


def hourly(events: DataFrame, view: HourlyView) -> DataFrame:
    """One row per entity and hour it was active in, stamped with the hour's close.

    Rolling counts go over buckets stamped in [t - 24 h, t], both ends included. Carried columns
    take their smallest value in the hour.
    """
    p = view.prefix
    shown, clicks = f"{p}_impressions", f"{p}_clicks"
    out = events.groupBy(*view.keys, bucket_close(F.col("ts")).alias("feature_ts")).agg(
        F.count(F.lit(1)).alias(f"{shown}_1h"), F.sum(F.col("clicked").cast("long")).alias(f"{clicks}_1h"), *[F.min(c).alias(c) for c in view.carried]
    )
    spans = [("24h", DAY_SECONDS)] * view.rolling + [("cum", None)] * view.cumulative
    for name, back in spans:
        over = frame(view.keys, "feature_ts", back)
        out = out.withColumns({f"{c}_{name}": F.sum(f"{c}_1h").over(over) for c in (shown, clicks)})
    if view.age:
        start = F.min(seconds(F.col("feature_ts"))).over(frame(view.keys, "feature_ts"))
        out = out.withColumn(view.age, (seconds(F.col("feature_ts")) - start) / 3600.0)
    return out


def global_rates(item_hourly: DataFrame) -> DataFrame:
    """(feature_ts, expanding and rolling totals) over all entities; one row per hour, so one task can order them."""
    hours = item_hourly.groupBy("feature_ts").agg(F.sum("item_impressions_1h").alias("__i"), F.sum("item_clicks_1h").alias("__c"))
    out = hours
    for name, back in (("cum", None), ("roll", DAY_SECONDS)):
        over = frame((), "feature_ts", back)
        out = out.withColumns({f"__all_{name}_i": F.sum("__i").over(over), f"__all_{name}_c": F.sum("__c").over(over)})
    return out.drop("__i", "__c")


def category_prior(item_hourly: DataFrame, min_impressions: int = MIN_PRIOR_IMPRESSIONS) -> DataFrame:
    """(category, feature_ts, cat_expanding_ctr, cat_rolling_ctr): the rate of a category as known at each hour."""
    out = item_hourly.groupBy("category", "feature_ts").agg(F.sum("item_impressions_1h").alias("__i"), F.sum("item_clicks_1h").alias("__c"))
    for name, back in (("cum", None), ("roll", DAY_SECONDS)):
        over = frame(("category",), "feature_ts", back)
        out = out.withColumns({f"__{name}_i": F.sum("__i").over(over), f"__{name}_c": F.sum("__c").over(over)})
    out = out.join(global_rates(item_hourly), "feature_ts", "left")

    def rate(span: str):
        own, everyone = F.col(f"__{span}_c") / F.col(f"__{span}_i"), F.col(f"__all_{span}_c") / F.col(f"__all_{span}_i")
        return F.when(F.col(f"__{span}_i") >= min_impressions, own).otherwise(everyone)

    return out.select("category", "feature_ts", rate("cum").alias("cat_expanding_ctr"), rate("roll").alias("cat_rolling_ctr"))


def item_rates(item_hourly: DataFrame, prior: DataFrame, strength: float = 20.0) -> DataFrame:
    """``item_hourly`` with its category's prior and the 24 h rate shrunk to it; no category, no prior."""
    out = item_hourly.join(prior.select("category", "feature_ts", "cat_expanding_ctr"), ["category", "feature_ts"], "left")
    return out.withColumn("item_ctr_smoothed", shrunk_rate(F.col("item_clicks_24h"), F.col("item_impressions_24h"), F.col("cat_expanding_ctr"), strength))


def user_rates(user_hourly: DataFrame, strength: float = 20.0) -> DataFrame:
    """``user_hourly`` with the 24 h rate shrunk to all users' expanding rate at that hour."""
    hours = user_hourly.groupBy("feature_ts").agg(F.sum("user_impressions_1h").alias("__i"), F.sum("user_clicks_1h").alias("__c"))
    over = frame((), "feature_ts")
    hours = hours.select("feature_ts", (F.sum("__c").over(over) / F.sum("__i").over(over)).alias("__prior"))
    out = user_hourly.join(hours, "feature_ts", "left")
    return out.withColumn("user_ctr_smoothed", shrunk_rate(F.col("user_clicks_24h"), F.col("user_impressions_24h"), F.col("__prior"), strength)).drop("__prior")


def user_category_affinity(events: DataFrame, strength: float = 5.0) -> DataFrame:
    """(user, category, hour) counts so far and the affinity shrunk to the user's own rate at that hour."""
    out = hourly(events, USER_CATEGORY)
    over = frame(("user_id",), "feature_ts")
    own = F.sum("user_cat_clicks_1h").over(over) / F.sum("user_cat_impressions_1h").over(over)
    out = out.withColumn("__own", own)
    out = out.withColumn("user_cat_affinity", shrunk_rate(F.col("user_cat_clicks_cum"), F.col("user_cat_impressions_cum"), F.col("__own"), strength))
    return out.select("user_id", "category", "feature_ts", "user_cat_impressions_cum", "user_cat_clicks_cum", "user_cat_affinity")


def require(rows: DataFrame, columns: Sequence[str], view: str) -> None:
    """Raises where a view lacks a column that its contract names."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{view} lacks {missing}")


def context(ts: str = "ts") -> dict:
    """hour_of_day and day_of_week (Sunday is 1)."""
    return {"hour_of_day": F.hour(ts), "day_of_week": F.dayofweek(ts)}


def tower_block(shown: str, clicks: str, found: str, hour: str, weekday: str) -> list:
    """The user block of a two-tower model: log counts, a flag, and time on two circles."""
    hour_sin, hour_cos = cyclic(F.col(hour), 24)
    day_sin, day_cos = cyclic(F.col(weekday) - 1, 7)
    return [
        F.log1p(F.coalesce(F.col(shown), F.lit(0)).cast("double")).alias("log_impressions"), F.log1p(F.coalesce(F.col(clicks), F.lit(0)).cast("double")).alias("log_clicks"),
        F.col(found).cast("double").alias("has_features"), hour_sin.alias("hour_sin"), hour_cos.alias("hour_cos"), day_sin.alias("day_sin"), day_cos.alias("day_cos"),
    ]
