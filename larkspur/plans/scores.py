"""Baseline scorers over the click log and over slates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.columns import digest_uniform
from larkspur.operators import scoring
from larkspur.registry import query
from larkspur.sources.shared import dealt, staged
from larkspur.sources.views import CLICKS_EV, SLATES_LI, clicks_ev, slates_li, table

CUT = "2024-01-16"
GAP = 259_200
PARTS_SQL = f"{CLICKS_EV}, train AS (SELECT * FROM clicks_ev WHERE ts < TIMESTAMP '{CUT}'), labels AS (SELECT * FROM clicks_ev WHERE ts >= TIMESTAMP '{CUT}')"
PRIOR_SQL = "prior AS (SELECT DISTINCT user_id, item_id, ts FROM clicks_ev WHERE clicked)"


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_ev(spark, sf_dir).where(f"ts < timestamp'{CUT}'")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_ev(spark, sf_dir).where(f"ts >= timestamp'{CUT}'")


def _told(df: DataFrame) -> DataFrame:
    return df.select("impression_id", "item_id", F.round("score", 9).alias("score"))


@query("click_counts", f"WITH {PARTS_SQL} SELECT item_id, count(*) AS clicks FROM train WHERE clicked GROUP BY item_id")
def click_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.click_counts(train(spark, sf_dir))


@query("score_random", f"WITH {CLICKS_EV} SELECT impression_id, item_id, round(('0x' || substr(md5(impression_id::VARCHAR || ':' || item_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 9) AS score FROM clicks_ev")
def score_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(clicks_ev(spark, sf_dir).withColumn("score", digest_uniform(F.col("impression_id").cast("string"), F.col("item_id").cast("string"))))


@query("score_popular", f"WITH {PARTS_SQL}, c AS (SELECT item_id, count(*) AS n FROM train WHERE clicked GROUP BY item_id) SELECT impression_id, item_id, coalesce(n, 0)::DOUBLE AS score FROM labels LEFT JOIN c USING (item_id)")
def score_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(scoring.popular(labels(spark, sf_dir), train(spark, sf_dir)))


def _decay_sql(half_life: float) -> str:
    age = "(floor(epoch(l.ts))::BIGINT - floor(epoch(c.ts))::BIGINT) / 86400.0::DOUBLE"
    return f"SELECT l.impression_id, l.item_id, coalesce(sum(exp(-ln(2) / {half_life}::DOUBLE * {age})), 0.0) AS score FROM labels l LEFT JOIN (SELECT item_id, ts FROM clicks_ev WHERE clicked) c ON l.item_id = c.item_id AND c.ts < l.ts GROUP BY l.impression_id, l.item_id"


@query("score_decayed", f"WITH {PARTS_SQL} SELECT impression_id, item_id, round(score, 9) AS score FROM ({_decay_sql(3)})")
def score_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(scoring.decayed(labels(spark, sf_dir), clicks_ev(spark, sf_dir).where("clicked"), 3.0))


HALF_LIVES = (0.02, 0.25, 1.0, 3.0, 10.0)


@query("decay_sweep", f"WITH {PARTS_SQL} " + " UNION ALL ".join(f"SELECT {h}::DOUBLE AS half_life, count(*) AS n, round(avg(score), 9) AS mean_score, round(max(score), 9) AS top_score FROM ({_decay_sql(h)})" for h in HALF_LIVES))
def decay_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All half-lives in one plan that reads labels and clicks once."""
    rows, clicks = labels(spark, sf_dir), clicks_ev(spark, sf_dir).where("clicked")
    runs = scoring.decayed_sweep(rows.select("impression_id", "item_id", "ts"), clicks, HALF_LIVES)
    return runs.groupBy("half_life").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.max("score"), 9).alias("top_score"))


SPECS = ("popular", "decayed@0.25", "decayed@3")


@query(
    "models_by_spec",
    f"""WITH {PARTS_SQL}, c AS (SELECT item_id, count(*) AS n FROM clicks_ev WHERE clicked GROUP BY item_id)
SELECT 'popular' AS model, count(*) AS n, round(avg(coalesce(n, 0)), 9) AS mean_score FROM labels LEFT JOIN c USING (item_id) UNION ALL """ + " UNION ALL ".join(f"SELECT '{s}', count(*), round(avg(score), 9) FROM ({_decay_sql(float(s.partition('@')[2]))})" for s in SPECS[1:]),
)
def models_by_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorers named by their specs, over the same labels."""
    rows, events = labels(spark, sf_dir), clicks_ev(spark, sf_dir)
    runs = [scoring.named(s)(rows, events).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score")).select(F.lit(s).alias("model"), "n", "mean_score") for s in SPECS]
    return reduce(DataFrame.unionByName, runs)


@query(
    "score_recent",
    f"""WITH {PARTS_SQL} SELECT l.impression_id, l.item_id, round(coalesce(1.0 / (1.0 + (floor(epoch(l.ts))::BIGINT - max(floor(epoch(c.ts))::BIGINT)) / 86400.0::DOUBLE), 0.0), 9) AS score
FROM labels l LEFT JOIN (SELECT item_id, ts FROM clicks_ev WHERE clicked) c ON l.item_id = c.item_id AND c.ts < l.ts GROUP BY l.impression_id, l.item_id, l.ts""",
)
def score_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(scoring.recent(labels(spark, sf_dir), clicks_ev(spark, sf_dir).where("clicked")))


STREAM_SQL = "stream AS (SELECT user_id, item_id, impression_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, impression_id, item_id)::INTEGER AS rank FROM train WHERE clicked)"
EDGES_SQL = f"""{STREAM_SQL},
pairs AS (SELECT a.item_id AS x, b.item_id AS y, 1.0 / log2(2.0 + (floor(epoch(b.ts))::BIGINT - floor(epoch(a.ts))::BIGINT) / 60.0::DOUBLE) AS w FROM stream a JOIN stream b ON a.user_id = b.user_id AND b.rank > a.rank AND b.rank <= a.rank + 30
  WHERE a.impression_id <> b.impression_id AND a.item_id <> b.item_id AND floor(epoch(b.ts))::BIGINT - floor(epoch(a.ts))::BIGINT <= {GAP}),
edges AS (SELECT item_id, related_item_id, sum(w) AS weight FROM (SELECT x AS item_id, y AS related_item_id, w FROM pairs UNION ALL SELECT y, x, w * 0.5 FROM pairs) GROUP BY item_id, related_item_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(weight, 9) DESC, related_item_id)::INTEGER AS rank FROM edges) WHERE rank <= 10)"""


@query("click_stream", f"WITH {PARTS_SQL}, {STREAM_SQL} SELECT * FROM stream")
def click_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.click_stream(train(spark, sf_dir))


@query("covisit_edges", f"WITH {PARTS_SQL}, {EDGES_SQL} SELECT item_id, related_item_id, round(weight, 9) AS weight FROM edges")
def covisit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.covisit_edges(train(spark, sf_dir), GAP).withColumn("weight", F.round("weight", 9))


def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.strongest(scoring.covisit_edges(train(spark, sf_dir), GAP), 10)


@query("covisit_topk", f"WITH {PARTS_SQL}, {EDGES_SQL} SELECT item_id, related_item_id, round(weight, 9) AS weight, rank FROM top")
def covisit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_edges(spark, sf_dir).withColumn("weight", F.round("weight", 9))


COVISIT_SQL = f"""{EDGES_SQL}, {PRIOR_SQL},
cov AS (SELECT l.impression_id, l.item_id, coalesce(sum(e.weight), 0.0) AS score FROM labels l LEFT JOIN prior p ON l.user_id = p.user_id AND p.ts < l.ts LEFT JOIN top e ON e.item_id = p.item_id AND e.related_item_id = l.item_id GROUP BY l.impression_id, l.item_id)"""


@query("covisit_score", f"WITH {PARTS_SQL}, {COVISIT_SQL} SELECT impression_id, item_id, round(score, 9) AS score FROM cov")
def covisit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(scoring.covisit(labels(spark, sf_dir), train(spark, sf_dir), top_edges(spark, sf_dir)))


@query(
    "covisit_reach",
    f"""WITH {PARTS_SQL}, {COVISIT_SQL} SELECT (SELECT count(*) FROM top) AS edges, (SELECT count(DISTINCT item_id) FROM top) AS sources, round(avg((score > 0)::INTEGER), 9) AS rows_scored,
  (SELECT round(avg(b), 9) FROM (SELECT max((score > 0)::INTEGER) AS b FROM cov GROUP BY impression_id)) AS slates_scored FROM cov""",
)
def covisit_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = top_edges(spark, sf_dir)
    scored = scoring.covisit(labels(spark, sf_dir), train(spark, sf_dir), edges)
    by_slate = scored.groupBy("impression_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("hit"))
    share = by_slate.agg(F.round(F.sum("hit") / F.sum("n"), 9).alias("rows_scored"), F.round(F.avg((F.col("hit") > 0).cast("int")), 9).alias("slates_scored"))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("item_id").alias("sources")).join(F.broadcast(share))  # one row each


@query("prior_clicks", f"WITH {CLICKS_EV}, {PRIOR_SQL} SELECT * FROM prior")
def prior_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.prior_clicks(labels(spark, sf_dir), train(spark, sf_dir))


STOPS = ", ".join(f"'{w}'" for w in scoring.STOP_TERMS)


def _terms_sql(source: str, ident: str, text: str) -> str:
    return f"terms AS (SELECT * FROM (SELECT {ident}, unnest(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9]+')) AS term FROM {source}) WHERE length(term) >= 2 AND term NOT IN ({STOPS}))"


def _tfidf_sql(source: str, ident: str, text: str) -> str:
    return f"""{_terms_sql(source, ident, text)}, tf AS (SELECT {ident}, term, count(*)::DOUBLE AS tf FROM terms GROUP BY {ident}, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT {ident}, term, tf * ln((SELECT count(DISTINCT {ident}) FROM {source})::DOUBLE / df) AS weight FROM tf JOIN df USING (term))"""


#: Terms of a text, about, for the number of tasks.
TERMS_A_TEXT = 100


def _dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) dealt by doc_id: texts are shuffled and not their terms, which are far larger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dealt(docs, docs.count() * TERMS_A_TEXT, "doc_id")


@query("tokenize", f"WITH {_terms_sql('documents', 'doc_id', 'text')} SELECT doc_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM terms GROUP BY doc_id")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = scoring.tokenize(_dealt_documents(spark, sf_dir), "doc_id", "text")
    per = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("n_terms"), F.count(F.lit(1)).alias("n_distinct"))


@query("tfidf_weights", f"WITH {_tfidf_sql('documents', 'doc_id', 'text')} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tfidf(_dealt_documents(spark, sf_dir), "doc_id", "text").withColumn("weight", F.round("weight", 6))


S_CUT = "2001-01-01"
CONTENT_SQL = f"""{SLATES_LI}, cat AS (SELECT p_partkey AS item_id, p_name || ' ' || p_type || ' ' || p_brand AS title FROM part), {_tfidf_sql('cat', 'item_id', 'title')},
w AS (SELECT * FROM weights WHERE weight <> 0), lab AS (SELECT * FROM slates_li WHERE ts >= TIMESTAMP '{S_CUT}'), pr AS (SELECT DISTINCT user_id, item_id, ts FROM slates_li WHERE clicked),
prof AS (SELECT q.user_id, q.ts, term, sum(weight) AS w FROM (SELECT DISTINCT user_id, ts FROM lab) q JOIN pr ON q.user_id = pr.user_id AND pr.ts < q.ts JOIN w ON w.item_id = pr.item_id GROUP BY q.user_id, q.ts, term),
pn AS (SELECT user_id, ts, sqrt(sum(w * w)) AS n FROM prof GROUP BY user_id, ts), cn AS (SELECT item_id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY item_id),
dots AS (SELECT l.impression_id, l.item_id, sum(w.weight * p.w) AS d FROM lab l JOIN w ON l.item_id = w.item_id JOIN prof p ON p.user_id = l.user_id AND p.ts = l.ts AND p.term = w.term GROUP BY l.impression_id, l.item_id)"""


@query("content_score", f"WITH {CONTENT_SQL} SELECT l.impression_id, l.item_id, round(coalesce(d / (cn.n * pn.n), 0.0), 9) AS score FROM lab l LEFT JOIN dots USING (impression_id, item_id) LEFT JOIN cn USING (item_id) LEFT JOIN pn USING (user_id, ts)")
def content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = slates_li(spark, sf_dir, catalogued=False).select("impression_id", "user_id", "item_id", "clicked", "ts")
    rows = staged(shown.where(f"clicked or ts >= timestamp'{S_CUT}'"), "content-slates")  # labels, and the clicks of the rest
    catalogue = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))
    return _told(scoring.content(rows.where(f"ts >= timestamp'{S_CUT}'"), rows.where(f"ts < timestamp'{S_CUT}'"), catalogue))


@query("als_score")
def als_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = scoring.als_factors(train(spark, sf_dir), rank=8, iterations=5)
    return scoring.als(labels(spark, sf_dir), model).select("impression_id", "item_id", "score")


@query("als_item_score")
def als_item_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = scoring.als_factors(train(spark, sf_dir), rank=8, iterations=5)
    return scoring.als_items(labels(spark, sf_dir), train(spark, sf_dir), model).select("impression_id", "item_id", "score")
