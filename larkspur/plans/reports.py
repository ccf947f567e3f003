"""Report cards of several models, contracts over the tables, and what an id translation drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.columns import digest_number
from larkspur.operators import contracts, inference, measure
from larkspur.plans.examples import SPLIT_SQL, slate_splits, test_of
from larkspur.plans.experiments import BOOT_SQL, REPLICATES
from larkspur.plans.metrics import MASK_SQL, SCORED_SQL, K, hash_score, scored
from larkspur.registry import query
from larkspur.sources.shared import dealt
from larkspur.sources.views import CLICKS_EV, SLATES_LI, clicks_ev, slates_li, table

COHORTS = ("overall", "warm_user", "cold_user", "warm_item", "cold_item")


@query(
    "cohort_report",
    f"""WITH {SCORED_SQL}, {MASK_SQL}, c AS (SELECT cohort, count(*) AS slates, count(*) FILTER (flat) AS flat_slates, sum(auc * n) / sum(n) FILTER (auc IS NOT NULL) AS gauc, 1.0 - 0.5 * avg(flat::INTEGER) AS ceiling FROM slates JOIN masks USING (impression_id) GROUP BY cohort),
cov AS (SELECT cohort, count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM part) AS coverage FROM ranked JOIN masks USING (impression_id) WHERE rank <= {K} GROUP BY cohort),
pu AS (SELECT cohort, user_id, avg(ndcg) AS d FROM slates JOIN masks USING (impression_id) GROUP BY cohort, user_id HAVING avg(ndcg) IS NOT NULL),
{BOOT_SQL.format(values='cohort, d', source='pu')}, m AS (SELECT cohort, r, sum(w * d) / nullif(sum(w), 0) AS v FROM boot GROUP BY cohort, r),
ci AS (SELECT cohort, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM m GROUP BY cohort), u AS (SELECT cohort, count(*) AS users, avg(d) AS ndcg_by_user FROM pu GROUP BY cohort)
SELECT cohort, slates, flat_slates, round(gauc, 9) AS gauc, round(ceiling, 9) AS gauc_ceiling, round(CASE WHEN ceiling > 0.5 THEN (gauc - 0.5) / (ceiling - 0.5) END, 9) AS headroom_used, round(coverage, 9) AS coverage,
  coalesce(users, 0) AS users, round(ndcg_by_user, 9) AS ndcg_by_user, round(lo, 6) AS lo, round(hi, 6) AS hi
FROM c LEFT JOIN cov USING (cohort) LEFT JOIN u USING (cohort) LEFT JOIN ci USING (cohort)""",
)
def cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cohort's ranking quality, the ceiling that flat slates leave and the share of it used, coverage, and the interval over users."""
    rows = scored(spark, sf_dir)
    masks = measure.with_cohort(rows)
    slates = measure.slate_metrics(rows, K).join(masks, "impression_id")
    told = slates.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("slates"), F.count_if("flat").alias("flat_slates"), measure.weighted_mean("auc", "n").alias("gauc"), (1.0 - 0.5 * F.avg(F.col("flat").cast("double"))).alias("gauc_ceiling")
    )
    size = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("__n"))
    served = measure.ranked(rows).where(F.col("rank") <= K).select("impression_id", "item_id").join(masks, "impression_id").groupBy("cohort").agg(F.count_distinct("item_id").alias("served"))
    served = served.join(F.broadcast(size)).select("cohort", (F.col("served") / F.col("__n")).alias("coverage"))  # one row
    # A column a cohort, so that a replicate weighs a user the same in all of them.
    wide = slates.groupBy("user_id").agg(*[F.avg(F.when(F.col("cohort") == c, F.col("ndcg"))).alias(c) for c in COHORTS])
    means = inference.bootstrap_means(wide, "user_id", COHORTS, REPLICATES)
    ends = means.agg(*[F.percentile(c, q).alias(f"{side}_{c}") for c in COHORTS for side, q in (("lo", 0.025), ("hi", 0.975))])
    by_user = wide.agg(*[f(c).alias(f"{side}_{c}") for c in COHORTS for side, f in (("users", F.count), ("mean", F.avg))])
    per = [F.struct(F.lit(c).alias("cohort"), *[F.col(f"{s}_{c}").alias(s) for s in ("users", "mean", "lo", "hi")]) for c in COHORTS]
    ends = ends.join(F.broadcast(by_user)).select(F.inline(F.array(*per)))  # one row each
    room = F.when(F.col("gauc_ceiling") > 0.5, (F.col("gauc") - 0.5) / (F.col("gauc_ceiling") - 0.5))
    out = told.withColumn("headroom_used", room).join(served, "cohort", "left").join(ends, "cohort", "left")
    rounded = [F.round(c, 9).alias(c) for c in ("gauc", "gauc_ceiling", "headroom_used", "coverage")]
    return out.select("cohort", "slates", "flat_slates", *rounded, "users", F.round("mean", 9).alias("ndcg_by_user"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(
    "model_table",
    f"""WITH {SPLIT_SQL}, {MASK_SQL}, pop AS (SELECT item_id, count(*) AS x FROM split WHERE split = 'train' AND clicked GROUP BY item_id),
two AS (SELECT c.*, round(('0x' || substr(md5(impression_id::VARCHAR || ':' || item_id::VARCHAR || ':s'), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 1) AS random, coalesce(x, 0)::DOUBLE AS popular FROM cohort c LEFT JOIN pop USING (item_id)),
long AS (SELECT 'random' AS model, impression_id, clicked, random AS score FROM two UNION ALL SELECT 'popular', impression_id, clicked, popular FROM two),
r AS (SELECT *, rank() OVER (PARTITION BY model, impression_id ORDER BY score) + (count(*) OVER (PARTITION BY model, impression_id, score) - 1) / 2.0 AS mid FROM long),
s AS (SELECT model, impression_id, count(*) AS n, (sum(mid) FILTER (clicked) - count(*) FILTER (clicked) * (count(*) FILTER (clicked) + 1) / 2.0)::DOUBLE / nullif(count(*) FILTER (clicked) * count(*) FILTER (NOT clicked), 0) AS auc FROM r GROUP BY model, impression_id)
SELECT model, """
    + ", ".join(f"round(sum(auc * n) FILTER (cohort = '{c}') / sum(n) FILTER (cohort = '{c}' AND auc IS NOT NULL), 9) AS {c}" for c in COHORTS)
    + " FROM s JOIN masks USING (impression_id) GROUP BY model",
)
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAUC of several models by cohort: the models are stacked, so slates and cohorts are made once."""
    split = slate_splits(spark, sf_dir)
    train = split.where("split = 'train' and clicked").groupBy("item_id").agg(F.count(F.lit(1)).alias("x"))
    rows = test_of(split)
    met = rows.join(train, "item_id", "left")
    models = {"random": hash_score(), "popular": F.coalesce("x", F.lit(0)).cast("double")}
    stacked = met.select("impression_id", "clicked", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), s.alias("score")) for m, s in models.items()])))
    slates = measure.slate_auc(stacked, ("model", "impression_id")).join(measure.with_cohort(rows), "impression_id")
    cards = slates.groupBy("model", "cohort").agg(measure.weighted_mean("auc", "n").alias("gauc")).withColumns({"split": F.lit("test"), "k": F.lit(K)})
    wide = measure.model_table(cards, "gauc", COHORTS)
    return wide.select("model", *[F.round(c, 9).alias(c) for c in COHORTS])


EVENT_TYPES = ("view", "signup", "click", "purchase", "error")
FLAGS = ("A", "N", "R")
#: A click rate outside of these bounds, or more shared history than this, is a violation.
CLICK_RATE, SHARED = (0.01, 0.15), 0.05


@query(
    "table_contracts",
    f"""WITH {CLICKS_EV}, {SPLIT_SQL}, sl AS (SELECT impression_id, count(*) AS n, count(DISTINCT slot) AS slots, min(slot) AS low FROM slates_li GROUP BY impression_id),
tr AS (SELECT DISTINCT user_id, item_id FROM split WHERE split = 'train' AND clicked), te AS (SELECT DISTINCT user_id, item_id FROM split WHERE split = 'test' AND clicked)
SELECT 'event_without_key' AS contract, count(*) FILTER (impression_id IS NULL OR user_id IS NULL OR ts IS NULL) AS violations FROM clicks_ev
UNION ALL SELECT 'event_without_item', count(*) FILTER (item_id IS NULL) FROM clicks_ev
UNION ALL SELECT 'event_type_unknown', count(*) FILTER (event_type NOT IN ({', '.join(map(repr, EVENT_TYPES))})) FROM events
UNION ALL SELECT 'event_value_not_finite', count(*) FILTER (isnan(value) OR isinf(value)) FROM events
UNION ALL SELECT 'event_click_rate', CASE WHEN avg(clicked::INTEGER) BETWEEN {CLICK_RATE[0]} AND {CLICK_RATE[1]} THEN 0 ELSE 1 END FROM clicks_ev
UNION ALL SELECT 'event_key_twice', (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY event_id HAVING count(*) > 1))
UNION ALL SELECT 'line_flag_unknown', count(*) FILTER (l_returnflag NOT IN ({', '.join(map(repr, FLAGS))})) FROM lineitem
UNION ALL SELECT 'line_without_order', (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey IS NOT NULL)
UNION ALL SELECT 'line_without_part', (SELECT count(*) FROM lineitem ANTI JOIN part ON l_partkey = p_partkey WHERE l_partkey IS NOT NULL)
UNION ALL SELECT 'order_without_customer', (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL)
UNION ALL SELECT 'part_twice', (SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_partkey HAVING count(*) > 1))
UNION ALL SELECT 'part_without_category', count(*) FILTER (p_brand IS NULL OR p_type IS NULL) FROM part
UNION ALL SELECT 'part_ids_not_dense', CASE WHEN max(p_partkey) - min(p_partkey) + 1 <> count(DISTINCT p_partkey) THEN 1 ELSE 0 END FROM part
UNION ALL SELECT 'embedding_twice', (SELECT count(*) FROM (SELECT 1 FROM embeddings GROUP BY vec_id HAVING count(*) > 1))
UNION ALL SELECT 'embedding_size', count(*) FILTER (len(embedding) <> 64) FROM embeddings
UNION ALL SELECT 'slate_short', count(*) FILTER (n < 2) FROM sl
UNION ALL SELECT 'slate_slot_twice', count(*) FILTER (slots < n) FROM sl
UNION ALL SELECT 'slate_slot_negative', count(*) FILTER (low < 0) FROM sl
UNION ALL SELECT 'slate_in_two_splits', (SELECT count(*) FROM (SELECT 1 FROM split GROUP BY impression_id HAVING min(split) < max(split)))
UNION ALL SELECT 'split_times_cross', CASE WHEN max(ts) FILTER (split = 'train') >= min(ts) FILTER (split = 'test') THEN 1 ELSE 0 END FROM split
UNION ALL SELECT 'history_shared', CASE WHEN (SELECT count(*) FROM te SEMI JOIN tr USING (user_id, item_id)) > {SHARED} * (SELECT count(*) FROM te) THEN 1 ELSE 0 END""",
)
def table_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the expectations on keys, vocabularies, references, dense ids, slates and splits."""
    raw, lines, parts = table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    vectors, clicks, split = table(spark, sf_dir, "embeddings"), clicks_ev(spark, sf_dir), slate_splits(spark, sf_dir)
    orders, n, n_events = table(spark, sf_dir, "orders"), lines.count(), raw.count()
    null = lambda *cs: F.greatest(*[F.col(c).isNull() for c in cs]) if len(cs) > 1 else F.col(cs[0]).isNull()
    value = F.col("value")
    # Slots are counted one by one first, so that a slate is grouped and not gathered; its lines are dealt once.
    slots = dealt(split.select("impression_id", "slot", "split"), n, "impression_id").groupBy("impression_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    slates = slots.groupBy("impression_id").agg(F.sum("n").alias("n"), F.count("slot").alias("slots"), F.min("slot").alias("low"), (F.min("a") < F.max("b")).alias("two"))
    # A (user, item) pair clicked in both splits: one grouping of both, not a join.
    pairs = dealt(split.where("clicked").select("user_id", "item_id", "split"), n, "user_id", "item_id").groupBy("user_id", "item_id").agg(F.bool_or(F.col("split") == "train").alias("old"), F.bool_or(F.col("split") == "test").alias("new"))
    return contracts.union(
        contracts.rows_where(clicks, {"event_without_key": null("impression_id", "user_id", "ts"), "event_without_item": null("item_id")}),
        contracts.rows_where(raw, {"event_type_unknown": ~F.col("event_type").isin(*EVENT_TYPES), "event_value_not_finite": F.isnan(value) | (F.abs(value) == float("inf"))}),
        contracts.totals(clicks, {"event_click_rate": ~F.avg(F.col("clicked").cast("int")).between(*CLICK_RATE)}),
        contracts.duplicate_keys(dealt(raw.select("event_id"), n_events, "event_id"), "event_key_twice", ["event_id"]),
        contracts.rows_where(lines, {"line_flag_unknown": ~F.col("l_returnflag").isin(*FLAGS)}),
        contracts.orphans(dealt(lines.select("l_orderkey"), n, "l_orderkey"), "line_without_order", "l_orderkey", orders, "o_orderkey"),
        contracts.orphans(dealt(lines.select("l_partkey"), n, "l_partkey"), "line_without_part", "l_partkey", parts, "p_partkey"),
        contracts.orphans(orders, "order_without_customer", "o_custkey", table(spark, sf_dir, "customer"), "c_custkey"),
        contracts.duplicate_keys(parts, "part_twice", ["p_partkey"]),
        contracts.rows_where(parts, {"part_without_category": null("p_brand", "p_type")}),
        contracts.totals(parts, {"part_ids_not_dense": F.max("p_partkey") - F.min("p_partkey") + 1 != F.count_distinct("p_partkey")}),
        contracts.duplicate_keys(vectors, "embedding_twice", ["vec_id"]),
        contracts.rows_where(vectors, {"embedding_size": F.size("embedding") != 64}),
        contracts.rows_where(slates, {"slate_short": F.col("n") < 2, "slate_slot_twice": F.col("slots") < F.col("n"), "slate_slot_negative": F.col("low") < 0, "slate_in_two_splits": F.col("two")}),
        contracts.totals(split, {"split_times_cross": F.max(F.when(F.col("split") == "train", F.col("ts"))) >= F.min(F.when(F.col("split") == "test", F.col("ts")))}),
        contracts.totals(pairs, {"history_shared": F.count_if(F.col("old") & F.col("new")) > SHARED * F.count_if("new")}),
    )


@query(
    "translation_counts",
    f"""WITH {CLICKS_EV}, im AS (SELECT DISTINCT item_id FROM clicks_ev WHERE ts < TIMESTAMP '2024-01-02'), um AS (SELECT DISTINCT user_id FROM clicks_ev WHERE ts < TIMESTAMP '2024-01-02'),
t AS (SELECT ts::DATE AS dt, u.user_id IS NOT NULL AS known_user, i.item_id IS NOT NULL AS known_item FROM clicks_ev e LEFT JOIN um u ON e.user_id = u.user_id LEFT JOIN im i ON e.item_id = i.item_id)
SELECT dt, count(*) AS asked, count(*) FILTER (known_user AND known_item) AS translated, count(*) FILTER (NOT known_user) AS unknown_user, count(*) FILTER (known_user AND NOT known_item) AS unknown_item FROM t GROUP BY dt""",
)
def translation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day, how many rows the first day's id maps translate and how many each map drops."""
    clicks = clicks_ev(spark, sf_dir).select("user_id", "item_id", "ts")
    early = clicks.where("ts < timestamp'2024-01-02'")
    known = [early.where(F.col(c).isNotNull()).select(c).distinct().withColumn(flag, F.lit(True)) for c, flag in (("user_id", "u"), ("item_id", "i"))]
    met = clicks.join(known[0], "user_id", "left").join(known[1], "item_id", "left")
    user, item = F.coalesce("u", F.lit(False)), F.coalesce("i", F.lit(False))
    return met.groupBy(F.to_date("ts").alias("dt")).agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(user & item).alias("translated"), F.count_if(~user).alias("unknown_user"), F.count_if(user & ~item).alias("unknown_item")
    )


BUCKETS = (250, 1000, 4000)


@query(
    "hash_collisions_trained",
    f"""WITH {SLATES_LI}, tr AS (SELECT DISTINCT item_id FROM slates_li WHERE clicked), f AS (SELECT l_partkey AS p_partkey, count(*) AS m FROM lineitem GROUP BY l_partkey),
h AS (SELECT p.p_partkey, b AS buckets, ('0x' || substr(md5(p.p_partkey::VARCHAR), 1, 8))::BIGINT % b AS bucket, tr.item_id IS NOT NULL AS trained, coalesce(m, 0) AS m FROM part p LEFT JOIN tr ON item_id = p_partkey LEFT JOIN f ON f.p_partkey = p.p_partkey, (VALUES {', '.join(f'({b})' for b in BUCKETS)}) AS t(b)),
c AS (SELECT *, count(*) OVER w AS n_all, count(*) FILTER (trained) OVER w AS n_trained FROM h WINDOW w AS (PARTITION BY buckets, bucket))
SELECT buckets, count(*) AS items, count(*) FILTER (trained) AS trained_items, round(avg((n_all > 1)::INTEGER), 9) AS catalogue_share, round(avg((n_trained > 1)::INTEGER) FILTER (trained), 9) AS trained_share,
  round((sum(m) FILTER (trained AND n_trained > 1))::DOUBLE / sum(m) FILTER (trained), 9) AS traffic_share, round(1 - pow(1 - 1.0 / buckets, count(*) - 1), 9) AS expected FROM c GROUP BY buckets""",
)
def hash_collisions_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of items that share a bucket with another item, of trained items that share one with another trained item, and the same by traffic, by table width."""
    trained = slates_li(spark, sf_dir).where("clicked").select(F.col("item_id").alias("p_partkey")).distinct().withColumn("t", F.lit(True))
    traffic = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("m"))
    items = table(spark, sf_dir, "part").select("p_partkey").join(trained, "p_partkey", "left").join(traffic, "p_partkey", "left")
    hashed = items.select(F.coalesce("t", F.lit(False)).alias("trained"), F.coalesce("m", F.lit(0)).alias("m"), digest_number(F.col("p_partkey").cast("string")).alias("h"), F.explode(F.array(*map(F.lit, BUCKETS))).alias("buckets"))
    # Sums by bucket, so that no window holds a bucket's items.
    held = hashed.groupBy("buckets", (F.col("h") % F.col("buckets")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("trained").alias("nt"), F.sum(F.when(F.col("trained"), F.col("m"))).alias("m"))
    among = lambda c, size: F.sum(F.when(F.col(size) > 1, F.col(c)).otherwise(0)) / F.sum(c)
    n = F.sum("n")
    return held.groupBy("buckets").agg(
        n.alias("items"), F.sum("nt").alias("trained_items"), F.round(among("n", "n"), 9).alias("catalogue_share"), F.round(among("nt", "nt"), 9).alias("trained_share"),
        F.round(F.try_divide(F.sum(F.when(F.col("nt") > 1, F.col("m"))).cast("double"), F.sum("m")), 9).alias("traffic_share"), F.round(1 - F.pow(1 - 1.0 / F.col("buckets"), n - 1), 9).alias("expected"),
    )
