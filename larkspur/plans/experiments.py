"""Experiment diagnostics, off-policy estimates and calibration over logs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.columns import digest_number, digest_uniform
from larkspur.operators import inference, measure
from larkspur.plans.examples import split_rows, test_rows
from larkspur.plans.metrics import EDGES, K, TWO_SQL, hash_score, two_models
from larkspur.registry import query
from larkspur.sources.shared import dealt
from larkspur.sources.views import slates_li, table


def _u(salt: str, column: str) -> str:
    return f"('0x' || substr(md5({column}::VARCHAR || ':{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


LOG_SQL = f"log AS (SELECT event_id, user_id, event_type = 'click' AS reward, 0.1 + 0.8 * {_u('l', 'event_id')} AS logging_prob, {_u('t', 'event_id')} AS target_prob, value, ts FROM events)"
UNIT_SQL = "unit AS (SELECT user_id, CASE WHEN ('0x' || substr(md5(user_id::VARCHAR || ':arm'), 1, 8))::BIGINT % 100 < 50 THEN 'control' ELSE 'treatment' END AS arm, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS pre, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS post FROM events GROUP BY user_id HAVING pre IS NOT NULL AND post IS NOT NULL)"


def policy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("event_type") == "click").alias("reward"), (0.1 + 0.8 * digest_uniform(ident, F.lit("l"))).alias("logging_prob"), digest_uniform(ident, F.lit("t")).alias("target_prob")
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(early, F.col("value"))).alias("pre"), F.avg(F.when(~early, F.col("value"))).alias("post"))
    arm = F.when(digest_number(F.col("user_id").cast("string"), F.lit("arm")) % 100 < 50, "control").otherwise("treatment")
    return out.where("pre is not null and post is not null").withColumn("arm", arm)


@query("ab_assign", "SELECT c_custkey AS user_id, CASE WHEN b < 1000 THEN 'holdback' WHEN b < 5500 THEN 'control' WHEN b < 10000 THEN 'treatment' END AS arm FROM (SELECT c_custkey, ('0x' || substr(md5('exp1:' || c_custkey::VARCHAR), 1, 8))::BIGINT % 10000 AS b FROM customer)")
def ab_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.withColumn("arm", inference.assign(F.col("user_id"), "exp1", {"holdback": 10, "control": 45, "treatment": 45}))


@query("srm_statistic", f"WITH {UNIT_SQL} SELECT count(*) AS n, round(pow(count(*) FILTER (arm = 'control') - count(*) * 0.5, 2) / (count(*) * 0.5) + pow(count(*) FILTER (arm = 'treatment') - count(*) * 0.5, 2) / (count(*) * 0.5), 9) AS statistic FROM unit")
def srm_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.sample_ratio_statistic(units(spark, sf_dir), {"control": 50, "treatment": 50}).withColumn("statistic", F.round("statistic", 9))


@query("cuped_theta", f"WITH {UNIT_SQL} SELECT count(*) AS n, round(covar_samp(pre, post) / var_samp(pre), 9) AS theta, round(corr(pre, post), 9) AS correlation, round(pow(corr(pre, post), 2), 9) AS variance_reduction, round(avg(pre), 9) AS pre_mean FROM unit")
def cuped_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.cuped_theta(units(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c != "n"})


@query("cuped_adjust", f"WITH {UNIT_SQL}, f AS (SELECT covar_samp(pre, post) / var_samp(pre) AS theta, avg(pre) AS m FROM unit) SELECT arm, count(*) AS n, round(avg(post - theta * (pre - m)), 9) AS adjusted, round(avg(post), 9) AS post FROM unit, f GROUP BY arm")
def cuped_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.cuped(units(spark, sf_dir)).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("adjusted"), 9).alias("adjusted"), F.round(F.avg("post"), 9).alias("post"))


@query("covariate_balance", f"WITH {UNIT_SQL}, w AS (SELECT count(*) AS n, sum(pre) AS s, stddev_samp(pre) AS sd FROM unit) SELECT arm, round((avg(pre) - (max(w.s) - sum(pre)) / (max(w.n) - count(*))) / max(sd), 9) AS smd FROM unit, w GROUP BY arm")
def covariate_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.balance(units(spark, sf_dir), "pre").withColumn("smd", F.round("smd", 9))


@query(
    "snips",
    f"""WITH {LOG_SQL}, w AS (SELECT *, target_prob / logging_prob AS raw, least(target_prob / logging_prob, 5.0) AS w FROM log)
SELECT count(*) AS n, round(avg(w * reward::INTEGER), 9) AS ips, round(sum(w * reward::INTEGER) / sum(w), 9) AS snips, round(sum(w) * sum(w) / sum(w * w), 6) AS ess, round(avg((raw > 5)::INTEGER), 9) AS clipped_share, round(max(raw), 9) AS max_weight, 0::BIGINT AS invalid FROM w""",
)
def snips(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.off_policy(policy_log(spark, sf_dir), clip=5.0)
    return out.withColumns({c: F.round(c, 6 if c == "ess" else 9) for c in ("ips", "snips", "ess", "clipped_share", "max_weight")})


REPLICATES = 200
BOOT_SQL = f"""boot AS (SELECT user_id, r, {{values}}, {" + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in inference._poisson_one()[:8])} AS w FROM (SELECT *, ('0x' || substr(md5(user_id::VARCHAR || ':' || r::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {{source}}, range({REPLICATES}) AS t(r)))"""


@query("bootstrap_ci", f"WITH {UNIT_SQL}, {BOOT_SQL.format(values='post', source='unit')}, m AS (SELECT sum(w * post) / sum(w) AS v FROM boot GROUP BY r) SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM m")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = inference.bootstrap_means(units(spark, sf_dir), "user_id", ["post"], REPLICATES)
    return inference.interval(means, F.col("post")).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(
    "bootstrap_impressions",
    f"WITH ev AS (SELECT event_id AS user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-16'), {BOOT_SQL.format(values='value', source='ev')}, m AS (SELECT sum(w * value) / sum(w) AS v FROM boot GROUP BY r) SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM m",
)
def bootstrap_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval that resamples impressions as if they were independent: too narrow, kept for comparison with the one over users."""
    rows = table(spark, sf_dir, "events").where("ts >= timestamp'2024-01-16'").select("event_id", "value")
    rows = dealt(rows, rows.count() * 10, "event_id")  # 200 hashes a row: a file's rows are too many for one task
    means = inference.bootstrap_means(rows, "event_id", ["value"], REPLICATES)
    return inference.interval(means, F.col("value")).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(
    "bootstrap_paired",
    f"WITH {TWO_SQL}, pu AS (SELECT * FROM (SELECT user_id, avg(b) - avg(a) AS d FROM two GROUP BY user_id) WHERE d IS NOT NULL), {BOOT_SQL.format(values='d', source='pu')}, m AS (SELECT sum(w * d) / sum(w) AS v FROM boot GROUP BY r) SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM m",
)
def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean per-user difference of two scorers over the same users."""
    users = two_models(spark, sf_dir).groupBy("user_id").agg((F.avg("b") - F.avg("a")).alias("d")).where("d is not null")
    return inference.interval(inference.bootstrap_means(users, "user_id", ["d"], REPLICATES), F.col("d")).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("band_compare_users")
def band_compare_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers per band of the clicked item's training clicks: row means, the paired difference by user and its interval."""
    rows = test_rows(spark, sf_dir)
    clicks = split_rows(slates_li(spark, sf_dir)).where("split = 'train' and clicked").groupBy("item_id").agg(F.count(F.lit(1)).alias("x"))
    hits = [
        measure.ranked(rows.withColumn("score", score)).where("clicked").select("impression_id", "user_id", "item_id", (F.col("rank") <= K).cast("int").alias(arm))
        for arm, score in (("a", hash_score()), ("b", hash_score("t", 2)))
    ]
    met = hits[0].join(hits[1].drop("user_id"), ["impression_id", "item_id"]).join(clicks, "item_id", "left").withColumn("x", F.coalesce("x", F.lit(0)))
    summary, users = measure.band_users(met, EDGES)
    # One column a band, so that a replicate weighs a user the same in all of them.
    names = [*measure.band_labels(EDGES), "<26", "overall"]
    wide = users.groupBy("user_id").agg(*[F.max(F.when(F.col("band") == name, F.col("difference"))).alias(f"d{i}") for i, name in enumerate(names)])
    means = inference.bootstrap_means(wide, "user_id", [f"d{i}" for i in range(len(names))], REPLICATES)
    ends = means.agg(*[F.percentile(f"d{i}", q).alias(f"{side}{i}") for i in range(len(names)) for side, q in (("lo", 0.025), ("hi", 0.975))])
    ends = ends.select(F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, n in enumerate(names)])).alias("e")).select("e.*")
    real = F.col("users") >= 2  # a difference of one user has no interval
    out = summary.join(ends, "band").withColumns({c: F.when(real, F.col(c)) for c in ("mean_difference", "lo", "hi")})
    return out.select("band", "n_rows", "users", *[F.round(c, 9).alias(c) for c in ("mean_a", "mean_b", "mean_difference", "lo", "hi")])


@query(
    "bootstrap_two_sample",
    f"""WITH {UNIT_SQL}, {BOOT_SQL.format(values='post, arm', source='unit')}, m AS (SELECT sum(w * post) FILTER (arm = 'treatment') / sum(w) FILTER (arm = 'treatment') - sum(w * post) FILTER (arm = 'control') / sum(w) FILTER (arm = 'control') AS v FROM boot GROUP BY r)
SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM m""",
)
def bootstrap_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("user_id", *[F.when(F.col("arm") == a, F.col("post")).alias(a) for a in ("control", "treatment")])
    means = inference.bootstrap_means(rows, "user_id", ["control", "treatment"], REPLICATES)
    return inference.interval(means, F.col("treatment") - F.col("control")).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


P_SQL = f"pr AS (SELECT doc_id, quality = 1 AS label, round({_u('p', 'doc_id')}, 3) AS probability FROM labels)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round(digest_uniform(F.col("doc_id").cast("string"), F.lit("p")), 3)
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("label"), p.alias("probability"))


RELIABILITY_SQL = f"""{P_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(probability, {[i / 10 for i in range(11)]}))) AS e FROM pr),
bins AS (SELECT least(len(list_filter(e, lambda x: x <= probability)) - 1, greatest(len(e) - 2, 0))::INTEGER AS bin, label, probability FROM pr, e),
rel AS (SELECT bin, count(*) AS n, avg(probability) AS predicted, avg(label::INTEGER)::DOUBLE AS observed FROM bins GROUP BY bin)"""


@query("reliability", f"WITH {RELIABILITY_SQL} SELECT bin, n, round(predicted, 9) AS predicted, round(observed, 9) AS observed FROM rel")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.reliability(predictions(spark, sf_dir).withColumn("label", F.col("label").cast("int")))
    return out.withColumns({c: F.round(c, 9) for c in ("predicted", "observed")})


@query("ece", f"WITH {RELIABILITY_SQL} SELECT round(sum(n * abs(predicted - observed)) / sum(n), 9) AS ece FROM rel")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = inference.reliability(predictions(spark, sf_dir).withColumn("label", F.col("label").cast("int")))
    return told.agg(F.round(inference.calibration_error(), 9).alias("ece"))


@query("log_loss", f"WITH {P_SQL}, c AS (SELECT label, greatest(least(probability, 1 - 1e-15), 1e-15) AS p FROM pr) SELECT round(avg(-CASE WHEN label THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss FROM c")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).agg(F.round(inference.log_loss(F.col("probability"), F.col("label")), 9).alias("log_loss"))


@query("isotonic_calibration")
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions mapped to observed rates by isotonic regression."""
    from pyspark.ml.regression import IsotonicRegression

    rows = predictions(spark, sf_dir).withColumn("y", F.col("label").cast("double"))
    model = IsotonicRegression(featuresCol="probability", labelCol="y", predictionCol="calibrated").fit(rows)
    return model.transform(rows).select("doc_id", "probability", "calibrated")


@query("head_size", "WITH c AS (SELECT l_partkey, count(*) AS x FROM lineitem GROUP BY l_partkey), r AS (SELECT x, sum(x) OVER (ORDER BY x DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(x) OVER () AS t FROM c) SELECT count(*) AS items, count(*) FILTER (coalesce(b, 0) < 0.8 * t) AS head FROM r")
def head_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.head_size(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(
    "ab_simulate",
    """WITH s AS (SELECT c_custkey AS u, CASE WHEN b < 5000 THEN 'control' ELSE 'treatment' END AS arm FROM (SELECT c_custkey, ('0x' || substr(md5('sim:' || c_custkey::VARCHAR), 1, 8))::BIGINT % 10000 AS b FROM customer)),
d AS (SELECT arm, position, ('0x' || substr(md5(u::VARCHAR || ':' || position::VARCHAR || ':item'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x, ('0x' || substr(md5(u::VARCHAR || ':' || position::VARCHAR || ':click'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS y FROM s, range(10) AS t(position))
SELECT arm, position::INTEGER AS position, count(*) AS shown, count(*) FILTER (y < x * x * CASE WHEN arm = 'treatment' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END / pow(position + 1.0::DOUBLE, 0.8::DOUBLE)) AS clicks FROM d GROUP BY arm, position""",
)
def ab_simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks by arm and position of simulated sessions: a relevance per item, halved less and less by position."""
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).withColumn("arm", inference.assign(F.col("user_id"), "sim", {"control": 50, "treatment": 50}))
    shown = sessions.select("user_id", "arm", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("position"))
    u = lambda salt: digest_uniform(F.col("user_id").cast("string"), F.col("position").cast("string"), F.lit(salt))
    relevance = u("item") * u("item") * F.when(F.col("arm") == "treatment", 1.1).otherwise(1.0)
    seen = relevance / F.pow(F.col("position") + 1.0, 0.8)
    return shown.withColumn("clicked", u("click") < seen).groupBy("arm", "position").agg(F.count(F.lit(1)).alias("shown"), F.count_if("clicked").alias("clicks"))
