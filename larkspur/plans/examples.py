"""As-of attachment, training examples, histories, negatives and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import features, timeline, transform
from larkspur.operators.timeline import Series
from larkspur.plans.series import CLICKS_EV, FLOOR, ITEM_RATE_SQL, ITEM_SQL, PRIOR_SQL, USER_CAT_SQL, USER_RATE_SQL, USER_SQL, item_series, user_series
from larkspur.registry import query
from larkspur.sources.shared import dealt, staged
from larkspur.sources.views import SLATES_LI, clicks_ev, slates_li

ITEM_COLUMNS = ("item_impressions_24h", "item_clicks_24h", "item_age_hours", "item_ctr_smoothed")
USER_COLUMNS = ("user_impressions_24h", "user_clicks_24h", "user_tenure_hours", "user_ctr_smoothed")
USER_CAT_COLUMNS = ("user_cat_impressions_cum", "user_cat_clicks_cum", "user_cat_affinity")


def _asof_sql(series: str, keys: list[str], columns: tuple[str, ...], labels: str = "clicks_ev") -> str:
    on = " AND ".join(f"l.{k} = f.{k}" for k in keys)
    return f"{labels} l ASOF LEFT JOIN {series} f ON {on} AND l.ts >= f.feature_ts"


def _item(spark: SparkSession, sf_dir: str) -> Series:
    return Series(item_series(spark, sf_dir), ("item_id",), "feature_ts", ITEM_COLUMNS)


def _user(spark: SparkSession, sf_dir: str) -> Series:
    return Series(user_series(spark, sf_dir), ("user_id",), "feature_ts", USER_COLUMNS)


def _user_category(spark: SparkSession, sf_dir: str) -> Series:
    return Series(features.user_category_affinity(clicks_ev(spark, sf_dir)), ("user_id", "category"), "feature_ts", USER_CAT_COLUMNS)


def _category(spark: SparkSession, sf_dir: str) -> Series:
    prior = features.category_prior(features.hourly(clicks_ev(spark, sf_dir), features.ITEM), FLOOR)
    return Series(prior, ("category",), "feature_ts", ("cat_expanding_ctr",))


def _rounded(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns if c.endswith(("ctr", "smoothed", "affinity", "effective"))})


def _round_sql(columns: tuple[str, ...], alias: str = "f") -> str:
    return ", ".join(f"round({alias}.{c}, 9) AS {c}" if c.endswith(("ctr", "smoothed", "affinity", "effective")) else f"{alias}.{c}" for c in columns)


@query("asof_item", f"WITH {CLICKS_EV}, {ITEM_SQL}, {PRIOR_SQL}, {ITEM_RATE_SQL} SELECT l.impression_id, {_round_sql(ITEM_COLUMNS)} FROM {_asof_sql('item_rates', ['item_id'], ITEM_COLUMNS)}")
def asof_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeline.attach_asof(clicks_ev(spark, sf_dir), _item(spark, sf_dir)), ITEM_COLUMNS).select("impression_id", *ITEM_COLUMNS)


@query("asof_user", f"WITH {CLICKS_EV}, {USER_SQL}, {USER_RATE_SQL} SELECT l.impression_id, {_round_sql(USER_COLUMNS)} FROM {_asof_sql('user_rates', ['user_id'], USER_COLUMNS)}")
def asof_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeline.attach_asof(clicks_ev(spark, sf_dir), _user(spark, sf_dir)), USER_COLUMNS).select("impression_id", *USER_COLUMNS)


@query("asof_user_category", f"WITH {CLICKS_EV}, {USER_CAT_SQL} SELECT l.impression_id, {_round_sql(USER_CAT_COLUMNS)} FROM {_asof_sql('user_cat', ['user_id', 'category'], USER_CAT_COLUMNS)}")
def asof_user_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeline.attach_asof(clicks_ev(spark, sf_dir), _user_category(spark, sf_dir)), USER_CAT_COLUMNS).select("impression_id", *USER_CAT_COLUMNS)


@query("asof_category", f"WITH {CLICKS_EV}, {ITEM_SQL}, {PRIOR_SQL} SELECT l.impression_id, round(f.cat_expanding_ctr, 9) AS cat_expanding_ctr FROM {_asof_sql('prior', ['category'], ())}")
def asof_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeline.attach_asof(clicks_ev(spark, sf_dir), _category(spark, sf_dir)), ("cat_expanding_ctr",)).select("impression_id", "cat_expanding_ctr")


ZERO_FILLED = ("item_impressions_24h", "item_clicks_24h", "user_impressions_24h", "user_clicks_24h", "user_cat_impressions_cum", "user_cat_clicks_cum")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with all series as last known, flags of what was known, context, and a rate for every row.

    Counts are filled with zero, rates never; a row whose item and category are both unknown goes.
    """
    out = timeline.attach_asof(clicks_ev(spark, sf_dir), _item(spark, sf_dir), _user(spark, sf_dir), _user_category(spark, sf_dir), _category(spark, sf_dir))
    known = {f"has_{n}_features": F.col(c).isNotNull() for n, c in (("item", "item_impressions_24h"), ("user", "user_impressions_24h"), ("user_cat", "user_cat_impressions_cum"))}
    out = out.withColumns(known | features.context() | {"item_ctr_effective": F.coalesce("item_ctr_smoothed", "cat_expanding_ctr")})
    return out.fillna(0, list(ZERO_FILLED)).where("item_ctr_effective is not null")


EXAMPLES_SQL = f"""examples AS (SELECT l.impression_id, l.user_id, l.item_id, l.category, l.clicked, l.ts, {_round_sql(tuple(c for c in ITEM_COLUMNS if c not in ZERO_FILLED), "i")}, {_round_sql(tuple(c for c in USER_COLUMNS if c not in ZERO_FILLED), "u")}, round(uc.user_cat_affinity, 9) AS user_cat_affinity,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in ZERO_FILLED)}, round(c.cat_expanding_ctr, 9) AS cat_expanding_ctr, round(coalesce(i.item_ctr_smoothed, c.cat_expanding_ctr), 9) AS item_ctr_effective,
  i.item_impressions_24h IS NOT NULL AS has_item_features, u.user_impressions_24h IS NOT NULL AS has_user_features, uc.user_cat_impressions_cum IS NOT NULL AS has_user_cat_features,
  hour(l.ts)::INTEGER AS hour_of_day, (dayofweek(l.ts) + 1)::INTEGER AS day_of_week
FROM clicks_ev l ASOF LEFT JOIN item_rates i ON l.item_id = i.item_id AND l.ts >= i.feature_ts ASOF LEFT JOIN user_rates u ON l.user_id = u.user_id AND l.ts >= u.feature_ts
  ASOF LEFT JOIN user_cat uc ON l.user_id = uc.user_id AND l.category = uc.category AND l.ts >= uc.feature_ts ASOF LEFT JOIN prior c ON l.category = c.category AND l.ts >= c.feature_ts
WHERE coalesce(i.item_ctr_smoothed, c.cat_expanding_ctr) IS NOT NULL)"""
ALL_SERIES_SQL = ", ".join((CLICKS_EV, ITEM_SQL, PRIOR_SQL, ITEM_RATE_SQL, USER_SQL, USER_RATE_SQL, USER_CAT_SQL))


@query("training_examples", f"WITH {ALL_SERIES_SQL}, {EXAMPLES_SQL} SELECT * FROM examples")
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(training_rows(spark, sf_dir), (*ITEM_COLUMNS, *USER_COLUMNS, *USER_CAT_COLUMNS, "cat_expanding_ctr", "item_ctr_effective"))


@query(
    "example_counts",
    f"WITH {ALL_SERIES_SQL}, {EXAMPLES_SQL} SELECT count(*) AS n, round(avg(clicked::INTEGER), 9) AS click_rate, round(avg(has_item_features::INTEGER), 9) AS item_share, round(avg(has_user_features::INTEGER), 9) AS user_share FROM examples",
)
def example_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 9)
    return training_rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), share("clicked").alias("click_rate"), share("has_item_features").alias("item_share"), share("has_user_features").alias("user_share"))


def _item_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.dense_ids(clicks_ev(spark, sf_dir), "item_id", "item_idx")


HISTORY_SQL = f"""{CLICKS_EV}, im AS (SELECT item_id, row_number() OVER (ORDER BY item_id)::INTEGER AS item_idx FROM (SELECT DISTINCT item_id FROM clicks_ev)),
snap_items AS (SELECT user_id, item_id, ts, impression_id FROM clicks_ev WHERE ts < TIMESTAMP '2024-01-08' AND clicked),
snap AS (SELECT user_id, list(item_idx ORDER BY ts DESC, impression_id DESC) AS snapshot_idx, count(*)::INTEGER AS snapshot_len FROM snap_items JOIN im USING (item_id) GROUP BY user_id),
req AS (SELECT impression_id, user_id, floor(epoch(ts))::BIGINT AS s FROM clicks_ev WHERE ts >= TIMESTAMP '2024-01-08'),
hit AS (SELECT user_id, item_idx, floor(epoch(ts))::BIGINT AS s FROM clicks_ev JOIN im USING (item_id) WHERE clicked AND ts >= TIMESTAMP '2024-01-08'),
inw AS (SELECT impression_id, list(item_idx ORDER BY h.s DESC, item_idx DESC) AS l FROM req r JOIN hit h ON r.user_id = h.user_id AND h.s < r.s GROUP BY impression_id)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = clicks_ev(spark, sf_dir).where("clicked and ts < timestamp'2024-01-08'")
    lists = old.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "impression_id", F.col("item_id").cast("string").alias("i")))).alias("l"))
    told = lists.select("user_id", F.array_join(F.transform("l", lambda x: x["i"]), " ").alias("history"))
    items = _item_map(spark, sf_dir).withColumn("item_id", F.col("item_id").cast("string"))
    return timeline.snapshot_history(told, items)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_ev(spark, sf_dir).where("ts >= timestamp'2024-01-08'").select("impression_id", "user_id", "item_id", "clicked", "ts")


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _requests(spark, sf_dir)
    clicks = asked.where("clicked").join(_item_map(spark, sf_dir), "item_id").select("user_id", "ts", "item_idx")
    return timeline.user_history(asked, timeline.clicks_before(asked.select("impression_id", "user_id", "ts"), clicks), _snapshots(spark, sf_dir))


@query("snapshot_history", f"WITH {HISTORY_SQL} SELECT user_id, snapshot_idx, snapshot_len FROM snap")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir)


USER_HISTORY_SQL = f"""{HISTORY_SQL}, hist AS (SELECT r.impression_id, list_concat(coalesce(l, []), coalesce(snapshot_idx, []))[1:50] AS history_idx, coalesce(len(l), 0)::INTEGER AS inwindow_len, coalesce(snapshot_len, 0) AS snapshot_len
  FROM req r LEFT JOIN inw USING (impression_id) LEFT JOIN snap USING (user_id))"""


@query("user_history", f"WITH {USER_HISTORY_SQL} SELECT *, len(history_idx)::INTEGER AS history_len, len(history_idx) > 0 AS has_history FROM hist")
def user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_rows(spark, sf_dir)


@query("history_counts", f"WITH {USER_HISTORY_SQL} SELECT count(*) AS n, count(*) FILTER (len(history_idx) > 0) AS with_history, round(avg(len(history_idx)), 9) AS mean_len, round(avg(inwindow_len), 9) AS mean_inwindow FROM hist")
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_history").alias("with_history"), F.round(F.avg("history_len"), 9).alias("mean_len"), F.round(F.avg("inwindow_len"), 9).alias("mean_inwindow"))


NEG_SQL = f"""{SLATES_LI}, pm AS (SELECT item_id, row_number() OVER (ORDER BY item_id)::INTEGER AS item_idx FROM (SELECT DISTINCT item_id FROM slates_li)),
neg AS (SELECT impression_id, list(item_idx ORDER BY md5(impression_id::VARCHAR || ':' || item_id::VARCHAR), item_idx)[1:20] AS neg_idx FROM slates_li JOIN pm USING (item_id) WHERE NOT clicked GROUP BY impression_id)"""


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slates_li(spark, sf_dir)
    return transform.slate_negatives(rows.join(transform.dense_ids(rows, "item_id", "item_idx"), "item_id"))


@query("slate_negatives", f"WITH {NEG_SQL} SELECT impression_id, neg_idx, len(neg_idx)::INTEGER AS neg_len FROM neg")
def slate_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives(spark, sf_dir)


@query("negative_counts", f"WITH {NEG_SQL} SELECT count(*) AS n, round(avg(len(neg_idx)), 9) AS mean_len, count(*) FILTER (len(neg_idx) >= 5) AS long_lists FROM neg")
def negative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("neg_len"), 9).alias("mean_len"), F.count_if(F.col("neg_len") >= 5).alias("long_lists"))


@query("pad_ragged", f"WITH {NEG_SQL} SELECT impression_id, list_concat(neg_idx, list_transform(range(0, 4), lambda x: 0))[1:4] AS padded, list_transform(range(0, 4), lambda x: x < len(neg_idx)) AS mask FROM neg")
def pad_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded, mask = timeline.pad(F.col("neg_idx"), 4, F.lit(0))
    return negatives(spark, sf_dir).select("impression_id", padded.alias("padded"), mask.alias("mask"))


@query(
    "request_tensors",
    f"""WITH {NEG_SQL}, s AS (SELECT impression_id, user_id, list(item_idx ORDER BY slot, item_id) AS shown_idx, bool_or(clicked) AS any_click FROM slates_li JOIN pm USING (item_id) GROUP BY impression_id, user_id)
SELECT impression_id, user_id, shown_idx, any_click, neg_idx FROM s LEFT JOIN neg USING (impression_id)""",
)
def request_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(slates_li(spark, sf_dir, catalogued=False).drop("ts"), "request-slates")
    # The slates are dealt once by impression; shown and negative lists and their join stay in that task.
    rows = dealt(rows.join(transform.dense_ids(rows, "item_id", "item_idx"), "item_id"), rows.count(), "impression_id")
    shown = rows.groupBy("impression_id", "user_id").agg(F.sort_array(F.collect_list(F.struct("slot", "item_id", "item_idx"))).alias("l"), F.bool_or("clicked").alias("any_click"))
    shown = shown.select("impression_id", "user_id", F.transform("l", lambda x: x["item_idx"]).alias("shown_idx"), "any_click")
    return shown.join(transform.slate_negatives(rows).select("impression_id", "neg_idx"), "impression_id", "left")


@query(
    "training_block",
    f"WITH {SLATES_LI} SELECT impression_id, user_id, min(ts) AS ts, count(*) FILTER (clicked) AS n_clicked FROM slates_li WHERE user_id IN (SELECT user_id FROM slates_li GROUP BY user_id HAVING count(DISTINCT impression_id) >= 10) GROUP BY impression_id, user_id",
)
def training_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per impression of users seen in ten or more."""
    slates = slates_li(spark, sf_dir).groupBy("impression_id", "user_id").agg(F.min("ts").alias("ts"), F.count_if("clicked").alias("n_clicked"))
    found = F.count(F.lit(1)).over(Window.partitionBy("user_id")) >= 10
    return slates.withColumn("found", found).where("found").drop("found")


HOLDOUT_DAYS = 180
SPLIT_SQL = f"""{SLATES_LI}, b AS (SELECT date_trunc('day', max(ts)) + INTERVAL 1 DAY - INTERVAL {2 * HOLDOUT_DAYS} DAY AS t1, date_trunc('day', max(ts)) + INTERVAL 1 DAY - INTERVAL {HOLDOUT_DAYS} DAY AS t2 FROM slates_li),
split AS (SELECT s.*, CASE WHEN anchor < t1 THEN 'train' WHEN anchor < t2 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, min(ts) OVER (PARTITION BY impression_id) AS anchor FROM slates_li) s, b),
cohort AS (SELECT *, user_id NOT IN (SELECT user_id FROM split WHERE split = 'train') AS is_cold_user, item_id NOT IN (SELECT item_id FROM split WHERE split = 'train') AS is_cold_item FROM split WHERE split = 'test')"""


def boundaries(rows: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """One row (t1, t2): whole days at the end for test, as many before for validation."""
    if holdout_days < 1:
        raise ValueError("holdout_days must be positive")
    end = F.date_trunc("day", F.max("ts")) + F.expr("INTERVAL 1 DAY")
    return rows.agg((end - F.expr(f"INTERVAL {2 * holdout_days} DAYS")).alias("t1"), (end - F.expr(f"INTERVAL {holdout_days} DAYS")).alias("t2"))


def split_rows(rows: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """``rows`` with split, by the earliest instant of their impression, so that a slate stays whole."""
    anchored = rows.withColumn("__a", F.min("ts").over(Window.partitionBy("impression_id")))
    return _by_anchor(anchored, boundaries(rows, holdout_days))


def _by_anchor(anchored: DataFrame, ends: DataFrame) -> DataFrame:
    met = anchored.join(F.broadcast(ends))  # one row
    name = F.when(F.col("__a") < F.col("t1"), "train").when(F.col("__a") < F.col("t2"), "val").otherwise("test")
    return met.withColumn("split", name).drop("__a", "t1", "t2")


def with_cohorts(rows: DataFrame, train: DataFrame) -> DataFrame:
    """``rows`` with flags of users and items that the training rows don't have."""
    users = train.select("user_id").distinct().withColumn("__u", F.lit(True))
    items = train.select("item_id").distinct().withColumn("__i", F.lit(True))
    out = rows.join(items, "item_id", "left").join(users, "user_id", "left")
    return out.withColumns({"is_cold_user": F.col("__u").isNull(), "is_cold_item": F.col("__i").isNull()}).drop("__u", "__i")


def slate_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split_rows`` of the slates without their categories, joined once and stored, so that every use reads them and joins nothing."""
    rows = slates_li(spark, sf_dir, catalogued=False)
    kept = staged(rows.withColumn("__a", F.min("ts").over(Window.partitionBy("impression_id"))), "slates")
    return _by_anchor(kept, boundaries(kept))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_of(slate_splits(spark, sf_dir))


def test_of(rows: DataFrame) -> DataFrame:
    """Test rows of a split table, flagged by its training rows."""
    return with_cohorts(rows.where("split = 'test'"), rows.where("split = 'train'"))


@query("split_boundaries", f"WITH {SPLIT_SQL} SELECT t1, t2 FROM b")
def split_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries(slates_li(spark, sf_dir))


@query("temporal_split", f"WITH {SPLIT_SQL} SELECT impression_id, item_id, split FROM split")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(slates_li(spark, sf_dir)).select("impression_id", "item_id", "split")


@query("label_cohorts", f"WITH {SPLIT_SQL} SELECT impression_id, item_id, user_id, is_cold_user, is_cold_item FROM cohort")
def label_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_rows(spark, sf_dir).select("impression_id", "item_id", "user_id", "is_cold_user", "is_cold_item")


@query("cohort_summary", f"WITH {SPLIT_SQL} SELECT is_cold_user, is_cold_item, count(*) AS n_rows, count(DISTINCT impression_id) AS impressions, count(DISTINCT user_id) AS users FROM cohort GROUP BY is_cold_user, is_cold_item")
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_rows(spark, sf_dir).groupBy("is_cold_user", "is_cold_item").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("impression_id").alias("impressions"), F.count_distinct("user_id").alias("users"))
