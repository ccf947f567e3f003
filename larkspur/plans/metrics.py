"""Evaluation of scored slates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import digest_uniform
from larkspur.operators import inference, measure
from larkspur.plans.examples import SPLIT_SQL, split_rows, test_rows
from larkspur.registry import query
from larkspur.sources.views import slates_li, table

K = 3
#: Scores rounded to one digit, so that slates hold ties.
SCORED_SQL = f"""{SPLIT_SQL}, scored AS (SELECT *, round(('0x' || substr(md5(impression_id::VARCHAR || ':' || item_id::VARCHAR || ':s'), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 1) AS score,
  md5(impression_id::VARCHAR || ':' || item_id::VARCHAR) AS tie FROM cohort),
ranked AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, tie) AS rank, rank() OVER (PARTITION BY impression_id ORDER BY score) + (count(*) OVER (PARTITION BY impression_id, score) - 1) / 2.0 AS mid FROM scored),
raw AS (SELECT impression_id, min(user_id) AS user_id, count(*) AS n, count(*) FILTER (clicked) AS p, sum(mid) FILTER (clicked) AS s, coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (clicked AND rank <= {K}), 0.0) AS dcg,
  count(*) FILTER (clicked AND rank <= {K}) AS hits, min(rank) FILTER (clicked) AS first, min(score) = max(score) AS flat FROM ranked GROUP BY impression_id),
slates AS (SELECT impression_id, user_id, n, p AS n_clicked, flat, (s - p * (p + 1) / 2.0)::DOUBLE / nullif(p * (n - p), 0) AS auc, CASE WHEN p > 0 THEN dcg / list_sum(list_transform(range(1, least(p, {K}) + 1), lambda i: 1.0 / log2(i + 1.0))) END AS ndcg,
  CASE WHEN p > 0 THEN hits::DOUBLE / p END AS recall, 1.0::DOUBLE / first AS reciprocal_rank FROM raw)"""
SUMMARY_SQL = "count(*) AS slates, count(auc) AS scored, round(sum(auc * n) / sum(n) FILTER (auc IS NOT NULL), 9) AS gauc, round(avg(ndcg), 9) AS ndcg, round(avg(recall), 9) AS recall, round(avg(reciprocal_rank), 9) AS mrr, round(1.0 - 0.5 * avg(flat::INTEGER), 9) AS gauc_ceiling"


def hash_score(salt: str = "s", digits: int = 1):
    return F.round(digest_uniform(F.col("impression_id").cast("string"), F.col("item_id").cast("string"), F.lit(salt)), digits)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_rows(spark, sf_dir).withColumn("score", hash_score())


def _round(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("slate_auc", f"WITH {SCORED_SQL} SELECT impression_id, n, n_clicked, round(auc, 9) AS auc FROM slates")
def slate_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(measure.slate_auc(scored(spark, sf_dir)), "auc").select("impression_id", "n", "n_clicked", "auc")


@query("gauc", f"WITH {SCORED_SQL} SELECT round(sum(auc * n) / sum(n) FILTER (auc IS NOT NULL), 9) AS gauc, count(auc) AS scored, count(*) - count(auc) AS skipped FROM slates")
def gauc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.slate_auc(scored(spark, sf_dir)).agg(F.round(measure.weighted_mean("auc", "n"), 9).alias("gauc"), F.count("auc").alias("scored"), F.count_if(F.col("auc").isNull()).alias("skipped"))


def _metric(name: str, column: str, alias: str) -> None:
    @query(name, f"WITH {SCORED_SQL} SELECT impression_id, round({column}, 9) AS {alias} FROM slates")
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return measure.slate_metrics(scored(spark, sf_dir), K).select("impression_id", F.round(column, 9).alias(alias))


_metric("recall_at_k", "recall", "recall")
_metric("ndcg_at_k", "ndcg", "ndcg")
_metric("mrr", "reciprocal_rank", "reciprocal_rank")


@query("ranking_eval", f"WITH {SCORED_SQL} SELECT {SUMMARY_SQL} FROM slates")
def ranking_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(measure.summary(measure.slate_metrics(scored(spark, sf_dir), K)), "gauc", "ndcg", "recall", "mrr", "gauc_ceiling")


@query("per_user_ndcg", f"WITH {SCORED_SQL} SELECT user_id, round(avg(ndcg), 9) AS ndcg FROM slates GROUP BY user_id HAVING avg(ndcg) IS NOT NULL")
def per_user_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.slate_metrics(scored(spark, sf_dir), K).groupBy("user_id").agg(F.round(F.avg("ndcg"), 9).alias("ndcg")).where("ndcg is not null")


@query("coverage_at_k", f"WITH {SCORED_SQL} SELECT count(DISTINCT item_id) AS served, round(count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM part), 9) AS coverage FROM ranked WHERE rank <= {K}")
def coverage_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = measure.ranked(scored(spark, sf_dir)).where(F.col("rank") <= K).agg(F.count_distinct("item_id").alias("served"))
    size = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    return served.join(F.broadcast(size)).select("served", F.round(F.col("served") / F.col("n"), 9).alias("coverage"))  # one row each


@query(
    "novelty",
    f"""WITH {SCORED_SQL}, c AS (SELECT item_id, count(*)::DOUBLE AS n FROM split WHERE split = 'train' AND clicked GROUP BY item_id), p AS (SELECT item_id, n / (SELECT sum(n) FROM c) AS p FROM c)
SELECT round(avg(-log2(coalesce(p.p, (SELECT min(p) FROM p)))), 9) AS novelty, count(*) AS n FROM ranked LEFT JOIN p USING (item_id) WHERE rank <= {K}""",
)
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(slates_li(spark, sf_dir))
    clicks = rows.where("split = 'train' and clicked").groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = clicks.agg(F.sum("n").alias("all"), F.min("n").alias("least"))
    served = measure.ranked(scored(spark, sf_dir)).where(F.col("rank") <= K).select("item_id")
    met = served.join(clicks, "item_id", "left").join(F.broadcast(total))  # one row
    return met.agg(F.round(F.avg(-F.log2(F.coalesce("n", "least") / F.col("all"))), 9).alias("novelty"), F.count(F.lit(1)).alias("n"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@query(
    "intra_list_diversity",
    f"""WITH {SCORED_SQL}, v AS (SELECT vec_id AS item_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), met AS (SELECT impression_id, item_id, e FROM scored JOIN v USING (item_id)),
pair AS (SELECT a.impression_id, avg(list_cosine_similarity(a.e, b.e)) AS c FROM met a JOIN met b ON a.impression_id = b.impression_id AND a.item_id < b.item_id GROUP BY a.impression_id)
SELECT m.impression_id, round(1.0 - c, 6) AS diversity FROM (SELECT DISTINCT impression_id FROM met) m LEFT JOIN pair USING (impression_id)""",
)
def intra_list_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(measure.diversity(scored(spark, sf_dir), vectors(spark, sf_dir)), "diversity", digits=6)


@query("gini_exposure", "WITH c AS (SELECT l_partkey, count(*) AS x FROM lineitem GROUP BY l_partkey), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM c) SELECT round(sum((2 * i - (SELECT count(*) FROM c) - 1) * x)::DOUBLE / ((SELECT count(*) FROM c) * sum(x)), 9) AS gini, count(*) AS n FROM r")
def gini_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("x"))
    return _round(measure.gini(counts, "x"), "gini")


MASK_SQL = """masks AS (SELECT impression_id, unnest(list_filter(['overall', CASE WHEN u THEN 'cold_user' ELSE 'warm_user' END, CASE WHEN i THEN 'cold_item' WHEN NOT i THEN 'warm_item' END], lambda x: x IS NOT NULL)) AS cohort
  FROM (SELECT impression_id, bool_or(is_cold_user) AS u, bool_or(is_cold_item) FILTER (clicked) AS i FROM cohort GROUP BY impression_id))"""


@query("cohort_masks", f"WITH {SPLIT_SQL}, {MASK_SQL} SELECT impression_id, cohort FROM masks")
def cohort_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.with_cohort(test_rows(spark, sf_dir))


def card(rows: DataFrame, k: int = K) -> DataFrame:
    """The summary of every cohort from one pass over the slates."""
    slates = measure.slate_metrics(rows, k).join(measure.with_cohort(rows), "impression_id")
    return _round(measure.summary(slates, ["cohort"]), "gauc", "ndcg", "recall", "mrr", "gauc_ceiling")


@query("report_card", f"WITH {SCORED_SQL}, {MASK_SQL} SELECT cohort, {SUMMARY_SQL} FROM slates JOIN masks USING (impression_id) GROUP BY cohort")
def report_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card(scored(spark, sf_dir))


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(impression_id, user_id, a, b): NDCG of two scorers on the same slates."""
    rows = test_rows(spark, sf_dir)
    a = measure.slate_metrics(rows.withColumn("score", hash_score()), K).select("impression_id", "user_id", F.col("ndcg").alias("a"))
    b = measure.slate_metrics(rows.withColumn("score", hash_score("t", 2)), K).select("impression_id", F.col("ndcg").alias("b"))
    return a.join(b, "impression_id")


TWO_SQL = f"""{SCORED_SQL}, other AS (SELECT impression_id, clicked, row_number() OVER (PARTITION BY impression_id ORDER BY round(('0x' || substr(md5(impression_id::VARCHAR || ':' || item_id::VARCHAR || ':t'), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 2) DESC, tie) AS rank FROM scored),
oslates AS (SELECT impression_id, CASE WHEN count(*) FILTER (clicked) > 0 THEN coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (clicked AND rank <= {K}), 0.0) / list_sum(list_transform(range(1, least(count(*) FILTER (clicked), {K}) + 1), lambda i: 1.0 / log2(i + 1.0))) END AS b FROM other GROUP BY impression_id),
two AS (SELECT impression_id, user_id, ndcg AS a, b FROM slates JOIN oslates USING (impression_id))"""


@query("compare_models", f"WITH {TWO_SQL} SELECT count(*) AS n, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, count(*) FILTER (a > b + 1e-9) AS a_wins, count(*) FILTER (b > a + 1e-9) AS b_wins FROM two")
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_models(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 9).alias("mean_a"), F.round(F.avg("b"), 9).alias("mean_b"), F.count_if(F.col("a") > F.col("b") + 1e-9).alias("a_wins"), F.count_if(F.col("b") > F.col("a") + 1e-9).alias("b_wins"))


@query(
    "quality_gate",
    f"""WITH {TWO_SQL}, {MASK_SQL}, u AS (SELECT cohort, user_id, avg(a) AS a, avg(b) AS b FROM two JOIN masks USING (impression_id) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY cohort, user_id),
m AS (SELECT cohort, count(*) AS n, avg(a) AS baseline, avg(b) AS candidate, avg(b - a) AS d, stddev_samp(b - a) / sqrt(count(*)) AS e FROM u GROUP BY cohort)
SELECT cohort, n, round(baseline, 9) AS baseline, round(candidate, 9) AS candidate, CASE WHEN baseline - candidate > 0.005 THEN 'fell' WHEN d + 1.96 * coalesce(e, 0) < 0 THEN 'significant fall' ELSE 'ok' END AS verdict FROM m""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the second scorer may replace the first, cohort by cohort."""
    pairs = two_models(spark, sf_dir).join(measure.with_cohort(test_rows(spark, sf_dir)), "impression_id")
    return _round(inference.gated(pairs), "baseline", "candidate")


@query("paired_difference", f"WITH {TWO_SQL}, u AS (SELECT user_id, avg(a) AS a, avg(b) AS b FROM two GROUP BY user_id) SELECT count(*) AS users, round(avg(b - a), 9) AS mean_difference FROM u WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = two_models(spark, sf_dir).groupBy("user_id").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).where("a is not null and b is not null")
    return users.agg(F.count(F.lit(1)).alias("users"), F.round(F.avg(F.col("b") - F.col("a")), 9).alias("mean_difference"))


@query(
    "baseline_table",
    f"WITH {SCORED_SQL}, {MASK_SQL}, c AS (SELECT cohort, sum(auc * n) / sum(n) FILTER (auc IS NOT NULL) AS gauc FROM slates JOIN masks USING (impression_id) GROUP BY cohort) SELECT 'random' AS model, round(max(gauc) FILTER (cohort = 'overall'), 9) AS overall, round(max(gauc) FILTER (cohort = 'warm_user'), 9) AS warm_user, round(max(gauc) FILTER (cohort = 'warm_item'), 9) AS warm_item FROM c",
)
def baseline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = card(scored(spark, sf_dir)).withColumn("model", F.lit("random")).groupBy("model").pivot("cohort", ["overall", "warm_user", "warm_item"]).agg(F.max("gauc"))
    return wide


EDGES = (0, 2, 5, 10, 25, 50, 100, 500)
BAND_SQL = "CASE " + " ".join(f"WHEN x <= {e} THEN '{lo if lo == e else f'{lo}-{e}'}'" for lo, e in zip((0, *[e + 1 for e in EDGES[:-1]]), EDGES, strict=True)) + " ELSE '501+' END"


@query(
    "popularity_bands",
    f"""WITH {SCORED_SQL}, c AS (SELECT item_id, count(*) AS x FROM split WHERE split = 'train' AND clicked GROUP BY item_id), bd AS (SELECT {BAND_SQL} AS band, x, clicked, rank FROM (SELECT clicked, rank, coalesce(x, 0) AS x FROM ranked LEFT JOIN c USING (item_id)))
SELECT coalesce(band, 'all') AS band, count(*) AS n_rows, round(avg((rank <= {K})::INTEGER), 9) AS recall FROM bd WHERE clicked GROUP BY ROLLUP (band)""",
)
def popularity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split_rows(slates_li(spark, sf_dir)).where("split = 'train' and clicked").groupBy("item_id").agg(F.count(F.lit(1)).alias("x"))
    met = measure.ranked(scored(spark, sf_dir)).join(train, "item_id", "left").where("clicked")
    banded = met.select(measure.bands(F.coalesce("x", F.lit(0)), EDGES).alias("band"), (F.col("rank") <= K).cast("int").alias("hit"))
    return banded.rollup("band").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("hit"), 9).alias("recall")).withColumn("band", F.coalesce("band", F.lit("all")))


@query(
    "slate_size_compare",
    f"""WITH {TWO_SQL}, t AS (SELECT impression_id, {BAND_SQL} AS band FROM (SELECT impression_id, count(*) AS x FROM cohort GROUP BY impression_id)) SELECT band, count(a) AS n, round(avg(b - a), 9) AS mean_difference FROM two JOIN t USING (impression_id) GROUP BY band""",
)
def slate_size_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of two scorers by slate size."""
    sizes = test_rows(spark, sf_dir).groupBy("impression_id").agg(F.count(F.lit(1)).alias("x"))
    met = two_models(spark, sf_dir).join(sizes, "impression_id").withColumn("band", measure.bands(F.col("x"), EDGES))
    return met.groupBy("band").agg(F.count("a").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 9).alias("mean_difference"))


@query("global_auc", f"WITH {SCORED_SQL}, r AS (SELECT clicked, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM scored) SELECT round((sum(mid) FILTER (clicked) - count(*) FILTER (clicked) * (count(*) FILTER (clicked) + 1) / 2.0)::DOUBLE / (count(*) FILTER (clicked) * count(*) FILTER (NOT clicked)), 9) AS auc, count(*) AS n FROM r")
def global_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(measure.global_auc(scored(spark, sf_dir)), "auc")


@query("funnel_ndcg", f"WITH {SCORED_SQL} SELECT count(*) AS requests, round(avg(coalesce(ndcg, 0)), 9) AS ndcg, round(avg((n_clicked > 0)::INTEGER), 9) AS ceiling FROM slates")
def funnel_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses count as zero; the ceiling is the share of requests whose click is among the candidates."""
    slates = measure.slate_metrics(scored(spark, sf_dir), K)
    return slates.agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg(F.coalesce("ndcg", F.lit(0.0))), 9).alias("ndcg"), F.round(F.avg((F.col("n_clicked") > 0).cast("int")), 9).alias("ceiling"))


@query("embedding_norm_check", "SELECT count(*) AS n, round(max(abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1)), 6) AS worst, bool_and(abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) < 1e-3) AS unit FROM embeddings")
def embedding_norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.abs(F.sqrt(measure.dot(F.col("vector"), F.col("vector"))) - 1)
    return vectors(spark, sf_dir).select(off.alias("off")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("off"), 6).alias("worst"), F.bool_and(F.col("off") < 1e-3).alias("unit"))


@query(
    "embedding_spread",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x, unnest(range(1, 65)) AS p FROM e),
s AS (SELECT p, sum(x) AS s FROM u GROUP BY p), n AS (SELECT count(*)::DOUBLE AS n FROM e) SELECT round(sqrt(sum(s * s)) / (SELECT n FROM n), 6) AS mean_norm, round((sum(s * s) - (SELECT n FROM n)) / ((SELECT n FROM n) * ((SELECT n FROM n) - 1)), 6) AS mean_cosine FROM s""",
)
def embedding_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the mean unit vector and the mean cosine over all pairs, from sums by dimension."""
    norm = F.sqrt(measure.dot(F.col("vector"), F.col("vector")))
    units = vectors(spark, sf_dir).select("item_id", F.posexplode(F.transform("vector", lambda x: x / norm)).alias("p", "x"))
    sums = units.groupBy("p").agg(F.sum("x").alias("s"), F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("n").alias("n"))
    return sums.select(F.round(F.sqrt("s2") / F.col("n"), 6).alias("mean_norm"), F.round((F.col("s2") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


@query(
    "embedding_rank",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM v GROUP BY i),
c AS (SELECT a.i, b.i AS j, avg(a.x * b.x) - any_value(p.m) * any_value(q.m) AS c FROM v a JOIN v b USING (vec_id) JOIN m p ON p.i = a.i JOIN m q ON q.i = b.i GROUP BY a.i, b.i)
SELECT round(pow(sum(c) FILTER (i = j), 2) / sum(c * c), 6) AS participation_ratio FROM c""",
)
def embedding_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participation ratio tr(C)^2 / tr(C^2) of the centred vectors, from the d x d matrix of sums."""
    v = vectors(spark, sf_dir)
    pairs = v.select(F.posexplode("vector").alias("i", "x"), "vector").select("i", F.posexplode("vector").alias("j", "y"), "x")
    second = pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    cov = second.withColumn("c", F.col("xy") / F.col("n") - F.col("sx") * F.col("sy") / (F.col("n") * F.col("n")))
    return cov.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))).alias("t"), F.sum(F.col("c") * F.col("c")).alias("t2")).select(F.round(F.col("t") * F.col("t") / F.col("t2"), 6).alias("participation_ratio"))


@query(
    "hash_collisions",
    """WITH h AS (SELECT p_partkey, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT % 1000 AS bucket FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY bucket) > 1 AS hit FROM h)
SELECT round(avg(hit::INTEGER), 9) AS catalogue_share, round((SELECT avg(hit::INTEGER) FROM lineitem JOIN c ON l_partkey = p_partkey), 9) AS traffic_share, round(1 - pow(1 - 1.0 / 1000, count(*) - 1), 9) AS expected FROM c""",
)
def hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.functions.columns import digest_number

    parts = table(spark, sf_dir, "part").select("p_partkey", (digest_number(F.col("p_partkey").cast("string")) % 1000).alias("bucket"))
    hit = parts.withColumn("hit", (F.count(F.lit(1)).over(Window.partitionBy("bucket")) > 1).cast("int"))
    traffic = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("m"))
    met = hit.join(traffic, "p_partkey", "left")
    n = F.count(F.lit(1))
    return met.agg(F.round(F.avg("hit"), 9).alias("catalogue_share"), F.round(F.sum(F.col("hit") * F.col("m")) / F.sum("m"), 9).alias("traffic_share"), F.round(1 - F.pow(F.lit(1 - 1.0 / 1000), n - 1), 9).alias("expected"))
