"""Nearest neighbours, candidate sources, blending, ranking rows and re-ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import cosine, digest_uniform
from larkspur.operators import candidates, measure, quantised, scoring, transform
from larkspur.plans.metrics import vectors
from larkspur.plans.scores import EDGES_SQL, PARTS_SQL, labels, top_edges, train
from larkspur.registry import query
from larkspur.sources.shared import staged
from larkspur.sources.views import CLICKS_EV, asked_items, clicks_ev, table

K = 10


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumnRenamed("item_id", "item")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector asks."""
    return _items(spark, sf_dir).where("item % 50 = 0").withColumnRenamed("item", "request")


KNN_SQL = f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
knn AS (SELECT request, item, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, item)::INTEGER AS rank FROM (SELECT q.vec_id AS request, i.vec_id AS item, list_dot_product(q.e, i.e) AS score FROM v q, v i WHERE q.vec_id % 50 = 0) QUALIFY rank <= {K})"""


@query("knn_exact", f"WITH {KNN_SQL} SELECT request, item, round(score, 6) AS score, rank FROM knn")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.knn_exact(_queries(spark, sf_dir), _items(spark, sf_dir), K).withColumn("score", F.round("score", 6))


@query("knn_ivf")
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.knn_ivf(_queries(spark, sf_dir), _items(spark, sf_dir), K)


@query(
    "half_dimension_agreement",
    f"""WITH {KNN_SQL}, half AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS r FROM (SELECT q.vec_id AS request, i.vec_id AS item, list_dot_product(q.e[1:32], i.e[1:32]) AS score FROM v q, v i WHERE q.vec_id % 50 = 0) QUALIFY r <= {K})
SELECT k.request, count(h.item) / {K}.0::DOUBLE AS agreement FROM knn k LEFT JOIN half h ON k.request = h.request AND k.item = h.item GROUP BY k.request""",
)
def half_dimension_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lists against lists from the first half of the dimensions."""
    cut = lambda df: df.withColumn("vector", F.slice("vector", 1, 32))
    exact = candidates.knn_exact(_queries(spark, sf_dir), _items(spark, sf_dir), K)
    return candidates.agreement(exact, candidates.knn_exact(cut(_queries(spark, sf_dir)), cut(_items(spark, sf_dir)), K), K)


@query("ann_index_agreement")
def ann_index_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lists against those of the registered index, knn_ivf at its own cells and probes, of every request."""
    exact = candidates.knn_exact(_queries(spark, sf_dir), _items(spark, sf_dir), K)
    return candidates.agreement(exact, knn_ivf(spark, sf_dir), K)


@query("knn_ivfpq")
def knn_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.knn_ivfpq(_queries(spark, sf_dir), _items(spark, sf_dir), K)


@query("ann_click_recall")
def ann_click_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the items that requests clicked, the share in the exact list of their mean vector and in the index's."""
    items, asked = (staged(df, f"click-recall-{name}") for name, df in (("items", _items(spark, sf_dir)), ("queries", mean_vectors(spark, sf_dir))))
    clicked = staged(candidates.scored_pairs(staged(truth(spark, sf_dir), "click-recall-truth"), asked, items), "click-recall-pairs")
    out = clicked.agg(F.count(F.lit(1)).alias("clicks"))
    for name, lists in (("exact", candidates.exact_lists(items, K)), ("index", quantised.lists(asked, items, K))):
        got = candidates.listed(clicked, asked, K, lists).agg(F.count(F.lit(1)).alias(f"{name}_hits"))
        out = out.join(F.broadcast(got))  # one row each
    return out.select("*", *[(F.col(f"{n}_hits") / F.greatest("clicks", F.lit(1))).alias(f"{n}_recall") for n in ("exact", "index")])


REQ_SQL = f"""{PARTS_SQL}, req AS (SELECT user_id AS request, max(ts) AS ts FROM labels GROUP BY user_id),
pop AS (SELECT item_id AS item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item_id)::INTEGER AS rank FROM train WHERE clicked GROUP BY item_id),
s_trend AS (SELECT request, item, rank FROM req, pop WHERE rank <= {K}),
hist AS (SELECT user_id AS request, item_id AS item, max(ts) AS ts FROM train WHERE clicked GROUP BY user_id, item_id),
s_recent AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY h.ts DESC, item)::INTEGER AS rank FROM hist h JOIN req USING (request) QUALIFY rank <= {K}),
{EDGES_SQL},
s_cov AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY round(s, 9) DESC, item)::INTEGER AS rank FROM (SELECT request, related_item_id AS item, sum(weight) AS s FROM hist JOIN req USING (request) JOIN top ON item_id = item GROUP BY request, related_item_id) QUALIFY rank <= {K})"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).groupBy(F.col("user_id").alias("request")).agg(F.max("ts").alias("ts"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = train(spark, sf_dir).where("clicked").groupBy(F.col("user_id").alias("request"), F.col("item_id").alias("item")).agg(F.max("ts").alias("last"))
    return hist.join(requests(spark, sf_dir), "request")


def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most clicked items, the same for every request: K rows, so they are sent to all."""
    counts = scoring.click_counts(train(spark, sf_dir)).select(F.col("item_id").alias("item"), F.col("clicks").alias("score"))
    top = counts.orderBy(F.col("score").desc(), "item").limit(K)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "item")))  # K rows
    return requests(spark, sf_dir).select("request").join(F.broadcast(top)).select("request", "item", "rank")


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.top_k(_history(spark, sf_dir).withColumn("score", F.unix_micros("last")), K).select("request", "item", "rank")


def covisited(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = top_edges(spark, sf_dir).select(F.col("item_id").alias("item"), F.col("related_item_id").alias("to"), "weight")
    sums = _history(spark, sf_dir).join(edges, "item").groupBy("request", F.col("to").alias("item")).agg(F.round(F.sum("weight"), 9).alias("score"))
    return candidates.top_k(sums, K, positive_only=True).select("request", "item", "rank")


@query("source_trending", f"WITH {REQ_SQL} SELECT * FROM s_trend")
def source_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending(spark, sf_dir)


@query("source_recent", f"WITH {REQ_SQL} SELECT * FROM s_recent")
def source_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(spark, sf_dir)


@query("source_covisit", f"WITH {REQ_SQL} SELECT * FROM s_cov")
def source_covisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covisited(spark, sf_dir)


def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request, vector): the mean vector of a request's history."""
    long = _history(spark, sf_dir).join(_items(spark, sf_dir), "item").select("request", F.posexplode("vector").alias("p", "x"))
    mean = long.groupBy("request", "p").agg(F.avg("x").alias("x")).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("l"))
    return mean.select("request", F.transform("l", lambda y: y["x"]).alias("vector"))


@query(
    "source_content",
    f"""WITH {REQ_SQL}, v AS (SELECT vec_id AS item, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT request, p, avg(x) AS x FROM (SELECT request, unnest(e) AS x, unnest(range(1, 65)) AS p FROM hist JOIN v USING (item) WHERE request IN (SELECT request FROM req)) GROUP BY request, p),
mean AS (SELECT request, list(x ORDER BY p) AS mv FROM m GROUP BY request)
SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY round(list_cosine_similarity(mv, e), 9) DESC, item)::INTEGER AS rank FROM mean, v WHERE item IN (SELECT item_id FROM clicks_ev) QUALIFY rank <= {K}""",
)
def source_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's items nearest to the mean vector of a request's history: exactly, or from some size on through the index."""
    items, asked = _items(spark, sf_dir), mean_vectors(spark, sf_dir)
    catalogue = clicks_ev(spark, sf_dir).select(F.col("item_id").alias("item")).distinct().join(items, "item")
    unit = lambda df: df.withColumn("vector", F.transform("vector", lambda x: x / F.sqrt(measure.dot(F.col("vector"), F.col("vector")))))
    found = quantised.knn(unit(asked), unit(catalogue), K)
    return found.select("request", "item", "rank")


SOURCES = ("trending", "recent", "covisit")
LISTS_SQL = f"{REQ_SQL}, lists AS (SELECT 'trending' AS source, * FROM s_trend UNION ALL SELECT 'recent', * FROM s_recent UNION ALL SELECT 'covisit', * FROM s_cov), truth AS (SELECT DISTINCT user_id AS request, item_id AS item FROM labels WHERE clicked)"


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [df.withColumn("source", F.lit(name)) for name, df in zip(SOURCES, (trending(spark, sf_dir), recent(spark, sf_dir), covisited(spark, sf_dir)), strict=True)]
    return reduce(DataFrame.unionByName, parts)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).where("clicked").select(F.col("user_id").alias("request"), F.col("item_id").alias("item")).distinct()


#: Quotas 4, 3, 3 and 12 slots in all, as one ordered list of claims per request.
BLEND_SQL = f"""{LISTS_SQL}, bl AS (SELECT *, row_number() OVER (PARTITION BY request, source ORDER BY rank) AS pos FROM lists WHERE item > 0),
q1 AS (SELECT request, item, 0 AS o, rank FROM bl WHERE source = 'trending' AND pos <= 4),
q2 AS (SELECT request, item, 1 AS o, rank FROM (SELECT l.*, row_number() OVER (PARTITION BY request ORDER BY rank) AS r FROM bl l WHERE source = 'recent' AND NOT EXISTS (SELECT 1 FROM q1 WHERE q1.request = l.request AND q1.item = l.item)) WHERE r <= 3),
q3 AS (SELECT request, item, 2 AS o, rank FROM (SELECT l.*, row_number() OVER (PARTITION BY request ORDER BY rank) AS r FROM bl l WHERE source = 'covisit' AND NOT EXISTS (SELECT 1 FROM q1 WHERE q1.request = l.request AND q1.item = l.item) AND NOT EXISTS (SELECT 1 FROM q2 WHERE q2.request = l.request AND q2.item = l.item)) WHERE r <= 3),
taken AS (SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3),
rest AS (SELECT request, item, min(3 + CASE source WHEN 'trending' THEN 0 WHEN 'recent' THEN 1 ELSE 2 END) AS o, min_by(rank, CASE source WHEN 'trending' THEN 0 WHEN 'recent' THEN 1 ELSE 2 END) AS rank FROM bl l WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.request = l.request AND t.item = l.item) GROUP BY request, item),
blended AS (SELECT request, item, (row_number() OVER (PARTITION BY request ORDER BY o, rank) - 1)::INTEGER AS position FROM (SELECT * FROM taken UNION ALL SELECT * FROM rest) QUALIFY position < 12)"""


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.blend(lists(spark, sf_dir), SOURCES, (4, 3, 3), 12)


@query("blend_quota", f"WITH {BLEND_SQL} SELECT * FROM blended")
def blend_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blended(spark, sf_dir)


@query("blend_attribution", f"WITH {LISTS_SQL}, h AS (SELECT request, item, source, count(*) OVER (PARTITION BY request, item) AS n FROM lists JOIN truth USING (request, item)) SELECT source, count(*) AS hits, count(*) FILTER (n = 1) AS unique_hits FROM h GROUP BY source")
def blend_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.attribution(lists(spark, sf_dir), truth(spark, sf_dir))


@query("blend_union_recall", f"WITH {LISTS_SQL} SELECT count(*) AS n, count(l.item) AS found, round(avg((l.item IS NOT NULL)::INTEGER), 9) AS recall FROM truth t LEFT JOIN (SELECT DISTINCT request, item FROM lists) l USING (request, item)")
def blend_union_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.union_recall(lists(spark, sf_dir), truth(spark, sf_dir)).withColumn("recall", F.round("recall", 9))


@query(
    "retrieval_eval",
    f"""WITH {LISTS_SQL}, per AS (SELECT t.request, count(*) AS n, count(l.item) AS hit FROM truth t LEFT JOIN (SELECT DISTINCT request, item FROM lists) l USING (request, item) GROUP BY t.request)
SELECT count(*) AS requests, round(avg(hit::DOUBLE / n), 9) AS recall, round(avg((hit > 0)::INTEGER), 9) AS reach, (SELECT count(DISTINCT item) FROM lists) AS distinct_items, round((SELECT count(*)::DOUBLE / count(DISTINCT request) FROM (SELECT DISTINCT request, item FROM lists)), 9) AS mean_pool FROM per""",
)
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = lists(spark, sf_dir).select("request", "item").distinct()
    met = truth(spark, sf_dir).join(pool.withColumn("f", F.lit(1)), ["request", "item"], "left").groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.count("f").alias("hit"))
    found = met.agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg(F.col("hit") / F.col("n")), 9).alias("recall"), F.round(F.avg((F.col("hit") > 0).cast("int")), 9).alias("reach"))
    sizes = pool.agg(F.count_distinct("item").alias("distinct_items"), F.round(F.count(F.lit(1)) / F.count_distinct("request"), 9).alias("mean_pool"))
    return found.join(F.broadcast(sizes))  # one row each


FEATURES_SQL = f"""{BLEND_SQL}, feats AS (SELECT b.request, b.item, b.position, coalesce(t.rank, 10000) AS rank_trending, coalesce(r.rank, 10000) AS rank_recent, coalesce(c.rank, 10000) AS rank_covisit,
  ((t.rank IS NOT NULL)::INTEGER + (r.rank IS NOT NULL)::INTEGER + (c.rank IS NOT NULL)::INTEGER)::INTEGER AS n_sources, coalesce(p.n, 0) AS train_clicks, coalesce(h.n, 0) AS history_length, p.n IS NULL AS is_cold
  FROM blended b LEFT JOIN s_trend t USING (request, item) LEFT JOIN s_recent r USING (request, item) LEFT JOIN s_cov c USING (request, item) LEFT JOIN pop p USING (item) LEFT JOIN (SELECT request, count(*) AS n FROM hist GROUP BY request) h USING (request))"""


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = candidates.rank_columns(blended(spark, sf_dir), lists(spark, sf_dir), SOURCES)
    clicks = scoring.click_counts(train(spark, sf_dir)).select(F.col("item_id").alias("item"), F.col("clicks").alias("__c"))
    seen = _history(spark, sf_dir).groupBy("request").agg(F.count(F.lit(1)).alias("__h"))
    out = out.join(clicks, "item", "left").join(seen, "request", "left")
    return out.withColumns({"train_clicks": F.coalesce("__c", F.lit(0)), "history_length": F.coalesce("__h", F.lit(0)), "is_cold": F.col("__c").isNull()}).drop("__c", "__h")


@query("ranking_features", f"WITH {FEATURES_SQL} SELECT * FROM feats")
def ranking_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(spark, sf_dir)


@query(
    "ranking_matrix",
    f"""WITH {FEATURES_SQL}, v AS (SELECT vec_id AS item, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT request, p, avg(x) AS x FROM (SELECT request, unnest(e) AS x, unnest(range(1, 65)) AS p FROM hist JOIN v USING (item)) GROUP BY request, p),
mean AS (SELECT request, list(x ORDER BY p) AS mv FROM m GROUP BY request), past AS (SELECT b.request, b.item, count(*) AS n FROM blended b JOIN req USING (request) JOIN clicks_ev c ON c.item_id = b.item AND c.clicked AND c.ts < req.ts GROUP BY b.request, b.item)
SELECT f.request, f.item, (count(*) OVER (PARTITION BY f.request) - f.position)::DOUBLE AS retrieval_score, rank_trending, n_sources, coalesce(past.n, 0) AS prior_clicks, train_clicks, round(coalesce(list_cosine_similarity(mv, e), 0), 6) AS content_similarity, history_length, is_cold,
  coalesce(brands.i, 0)::INTEGER AS category_idx, coalesce(types.i, 0)::INTEGER AS subcategory_idx, NOT (v.item IS NOT NULL AND mv IS NOT NULL) AS incomplete
FROM feats f LEFT JOIN past USING (request, item) LEFT JOIN v USING (item) LEFT JOIN mean USING (request) LEFT JOIN part ON p_partkey = item
  LEFT JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS i FROM (SELECT DISTINCT p_brand FROM part)) brands USING (p_brand) LEFT JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) AS i FROM (SELECT DISTINCT p_type FROM part)) types USING (p_type)""",
)
def ranking_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranker's columns of each candidate; ``incomplete`` rows lack a vector and have similarity 0.

    Earlier clicks of an item are an as-of count over one union; the mean vector is one row a request.
    """
    rows = feature_rows(spark, sf_dir).join(requests(spark, sf_dir), "request")
    hits = clicks_ev(spark, sf_dir).where("clicked").groupBy(F.col("item_id").alias("item"), "ts").agg(F.count(F.lit(1)).alias("__n"))
    both = rows.withColumn("__row", F.lit(True)).unionByName(hits, allowMissingColumns=True).withColumn("__us", F.unix_micros("ts"))
    before = Window.partitionBy("item").orderBy("__us").rangeBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("prior_clicks", F.coalesce(F.sum("__n").over(before), F.lit(0))).where("__row")
    items, part = _items(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type")
    for name in ("p_brand", "p_type"):  # the catalogue's vocabularies, numbered from 1; 0 where the catalogue hasn't the item
        part = part.join(transform.dense_ids(part, name, f"__{name}"), name, "left")
    rows = rows.join(part.select("item", "__p_brand", "__p_type"), "item", "left")
    rows = rows.join(items.withColumnRenamed("vector", "__v"), "item", "left").join(mean_vectors(spark, sf_dir).withColumnRenamed("vector", "__m"), "request", "left")
    size = F.count(F.lit(1)).over(Window.partitionBy("request"))
    return rows.select(
        "request", "item", (size - F.col("position")).cast("double").alias("retrieval_score"), "rank_trending", "n_sources", "prior_clicks", "train_clicks",
        F.round(F.coalesce(cosine(F.col("__m"), F.col("__v")), F.lit(0.0)), 6).alias("content_similarity"), "history_length", "is_cold",
        F.coalesce("__p_brand", F.lit(0)).alias("category_idx"), F.coalesce("__p_type", F.lit(0)).alias("subcategory_idx"), (F.col("__v").isNull() | F.col("__m").isNull()).alias("incomplete"),
    )


@query(
    "retrieval_protocol",
    f"""WITH {LISTS_SQL}, pools AS (SELECT DISTINCT request, item FROM lists), sizes AS (SELECT request, count(p.item) AS n FROM req LEFT JOIN pools p USING (request) GROUP BY request),
pr AS (SELECT item, n::DOUBLE / (SELECT sum(n) FROM pop) AS p FROM pop), cat AS (SELECT count(DISTINCT item_id) AS n FROM clicks_ev)
SELECT (SELECT count(*) FROM sizes) AS requests, (SELECT count(*) FROM sizes WHERE n < {K}) AS short_pools, (SELECT n < {K} FROM cat) AS small_catalogue,
  round(avg(-log2(coalesce(p, (SELECT min(p) FROM pr)))), 9) AS novelty, round(count(DISTINCT item)::DOUBLE / (SELECT n FROM cat), 9) AS coverage FROM pools LEFT JOIN pr USING (item)""",
)
def retrieval_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retrieval report needs besides recall: novelty and coverage of the pools, and whether pools or the catalogue are too small for K."""
    pools = lists(spark, sf_dir).select("request", "item").distinct()
    sizes = requests(spark, sf_dir).join(pools, "request", "left").groupBy("request").agg(F.count("item").alias("n"))
    sizes = sizes.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("n") < K).alias("short_pools"))
    clicks = scoring.click_counts(train(spark, sf_dir)).select(F.col("item_id").alias("item"), F.col("clicks").cast("double").alias("c"))
    total = clicks.agg(F.sum("c").alias("all"), F.min("c").alias("least"))
    catalogue = clicks_ev(spark, sf_dir).agg(F.count_distinct("item_id").alias("catalogue"))
    told = pools.join(clicks, "item", "left").join(F.broadcast(total)).agg(F.round(F.avg(-F.log2(F.coalesce("c", "least") / F.col("all"))), 9).alias("novelty"), F.count_distinct("item").alias("items"))
    out = told.join(F.broadcast(sizes)).join(F.broadcast(catalogue))  # one row each
    return out.select("requests", "short_pools", (F.col("catalogue") < K).alias("small_catalogue"), "novelty", F.round(F.col("items") / F.col("catalogue"), 9).alias("coverage"))


@query(
    "pools_by_size",
    f"WITH {LISTS_SQL}, n AS (SELECT request, count(DISTINCT item) AS n FROM req LEFT JOIN lists USING (request) GROUP BY request) SELECT least(n, {K}) AS size, count(*) AS requests FROM n GROUP BY ALL",
)
def pools_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by how many candidates they have, K or more as K: what ``measure.require_pools`` refuses and what it lets pass."""
    pools = lists(spark, sf_dir).select("request", "item").distinct()
    sizes = requests(spark, sf_dir).join(pools, "request", "left").groupBy("request").agg(F.count("item").alias("n"))
    return sizes.groupBy(F.least("n", F.lit(K)).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("requests"))


@query("ranking_rows", f"WITH {FEATURES_SQL}, r AS (SELECT f.*, t.item IS NOT NULL AS label FROM feats f LEFT JOIN truth t USING (request, item)) SELECT request, item, label, bool_or(label) OVER (PARTITION BY request) AS found, count(*) OVER (PARTITION BY request) AS group_size FROM r")
def ranking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their label, whether the request's click is among them, and the group's size."""
    met = feature_rows(spark, sf_dir).join(truth(spark, sf_dir).withColumn("__t", F.lit(True)), ["request", "item"], "left").withColumn("label", F.col("__t").isNotNull())
    group = Window.partitionBy("request")
    return met.select("request", "item", "label", F.bool_or("label").over(group).alias("found"), F.count(F.lit(1)).over(group).alias("group_size"))


POOL_SQL = f"{BLEND_SQL}, pool AS (SELECT request, item, (item % 8)::VARCHAR AS category, round(('0x' || substr(md5(request::VARCHAR || ':' || item::VARCHAR || ':r'), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 6) AS score FROM blended)"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(digest_uniform(F.col("request").cast("string"), F.col("item").cast("string"), F.lit("r")), 6)
    return blended(spark, sf_dir).select("request", "item", (F.col("item") % 8).cast("string").alias("category"), score.alias("score"))


@query("topk_scores", f"WITH {POOL_SQL} SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY score DESC, item)::INTEGER AS rank FROM pool QUALIFY rank <= 5")
def topk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.top_k(pool(spark, sf_dir), 5).select("request", "item", "rank")


@query("freshness_boost", f"WITH {CLICKS_EV}, a AS (SELECT item_id, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(min(ts)))) / 3600.0 AS age FROM clicks_ev GROUP BY item_id) SELECT item_id, round(pow(2.0, -age / 24.0), 12) AS boost FROM a")
def freshness_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp("first")) / 3600.0
    first = clicks_ev(spark, sf_dir).groupBy("item_id").agg(F.min("ts").alias("first"))
    return first.select("item_id", F.round(candidates.freshness(age, 24.0), 12).alias("boost"))


@query("rerank_cap", f"WITH {POOL_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY request, category ORDER BY score DESC, item) > 2 AS over FROM pool) SELECT request, item, category, score, row_number() OVER (PARTITION BY request ORDER BY over, score DESC, item)::INTEGER AS position FROM o QUALIFY position <= 6")
def rerank_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.capped(pool(spark, sf_dir), 6, 2)


def mmr_slates(spark: SparkSession, sf_dir: str, relevance: float = 0.7, epsilon: float = 0.1) -> DataFrame:
    return candidates.greedy_slates(pool(spark, sf_dir).join(_items(spark, sf_dir), "item"), 6, relevance=relevance, cap=2, epsilon=epsilon, explore=2 if epsilon else 0)


@query("rerank_mmr")
def rerank_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mmr_slates(spark, sf_dir)


@query(
    "slate_scorecard",
    f"""WITH {POOL_SQL}, s AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM pool QUALIFY rank <= 6),
d AS (SELECT request, coalesce(sum(1 / log2(rank + 1.0)) FILTER (t.item IS NOT NULL), 0) / coalesce(nullif(list_sum(list_transform(range(1, least(count(t.item), 6) + 1), lambda i: 1 / log2(i + 1.0))), 0), 1) AS ndcg FROM s LEFT JOIN truth t USING (request, item) GROUP BY request)
SELECT (SELECT round(avg(ndcg), 9) FROM d) AS ndcg, count(DISTINCT item) AS distinct_items, round(count(DISTINCT item)::DOUBLE / (SELECT count(DISTINCT item) FROM pool), 9) AS coverage, round(avg((coalesce(p.n, 0) < 10)::INTEGER), 9) AS tail_share FROM s LEFT JOIN pop p USING (item)""",
)
def slate_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG in the order served, coverage of the pool and the share of rarely clicked items."""
    all_ = pool(spark, sf_dir)
    slate = candidates.top_k(all_, 6).select("request", "item", "rank")
    clicks = scoring.click_counts(train(spark, sf_dir)).select(F.col("item_id").alias("item"), "clicks")
    met = slate.join(truth(spark, sf_dir).withColumn("hit", F.lit(1)), ["request", "item"], "left").join(clicks, "item", "left")
    per = met.groupBy("request").agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"), F.count("hit").alias("p"))
    ndcg = per.agg(F.round(F.avg(F.col("dcg") / measure.ideal_dcg(F.col("p"), 6)), 9).alias("ndcg"))
    shown = met.agg(F.count_distinct("item").alias("distinct_items"), F.round(F.avg((F.coalesce("clicks", F.lit(0)) < 10).cast("int")), 9).alias("tail_share"))
    size = all_.agg(F.count_distinct("item").alias("n"))
    out = ndcg.join(F.broadcast(shown)).join(F.broadcast(size))  # one row each
    return out.select("ndcg", "distinct_items", F.round(F.col("distinct_items") / F.col("n"), 9).alias("coverage"), "tail_share")


EPSILON, EXPLORED = 0.2, 2
_DRAW = "('0x' || substr(md5('0:' || request::VARCHAR || ':' || ({slot})::VARCHAR || ':{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _draw(slot: str, n: str) -> str:
    """The place among n open items that a slot takes: 0 but for exploration."""
    return f"CASE WHEN {_DRAW.format(slot=slot, salt='explores')} < {EPSILON} THEN floor({_DRAW.format(slot=slot, salt='picks')} * {n})::BIGINT ELSE 0 END"


#: Slots before the last two hold the best items; of these two, each takes the best open item or, with a probability, any open one.
SLATES_SQL = f"""{POOL_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS r, count(*) OVER (PARTITION BY request) AS size FROM pool),
slots AS (SELECT DISTINCT request, size, least(6, size) AS total, greatest(least(6, size) - {EXPLORED}, 0) AS sure FROM placed),
late_one AS (SELECT *, {_draw("sure", "(size - sure)")} AS p1 FROM slots), late_two AS (SELECT *, CASE WHEN total - sure > 1 THEN {_draw("sure + 1", "(size - sure - 1)")} END AS p2, sure + 1 + p1 AS r1 FROM late_one),
picked AS (SELECT *, sure + 1 + p2 + CASE WHEN p2 >= p1 THEN 1 ELSE 0 END AS r2 FROM late_two),
slates AS (SELECT placed.request, item, CASE WHEN r <= sure THEN 1.0::DOUBLE WHEN r = r1 THEN {EPSILON} / (t.size - sure) + CASE WHEN p1 = 0 THEN {1 - EPSILON} ELSE 0 END ELSE {EPSILON} / (t.size - sure - 1) + CASE WHEN p2 = 0 THEN {1 - EPSILON} ELSE 0 END END AS propensity
  FROM placed JOIN picked t USING (request) WHERE r <= sure OR r = r1 OR r = r2)"""


@query(
    "slate_diversity",
    f"""WITH {SLATES_SQL}, v AS (SELECT vec_id AS item, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT request, item FROM slates JOIN v USING (item)),
d AS (SELECT a.request, 1 - avg(list_cosine_similarity(va.e, vb.e)) AS d FROM s a JOIN s b ON a.request = b.request AND a.item < b.item JOIN v va ON va.item = a.item JOIN v vb ON vb.item = b.item GROUP BY a.request)
SELECT round(avg(d), 6) AS diversity, (SELECT round(avg(propensity), 9) FROM slates) AS mean_propensity FROM d""",
)
def slate_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean intra-list diversity of slates whose last two slots explore, and the mean propensity of what they show."""
    slates = staged(candidates.greedy_slates(pool(spark, sf_dir), 6, epsilon=EPSILON, explore=EXPLORED), "slates")
    per = measure.diversity(slates.select(F.col("request").alias("impression_id"), F.col("item").alias("item_id")), vectors(spark, sf_dir))
    return per.agg(F.round(F.avg("diversity"), 6).alias("diversity")).join(F.broadcast(slates.agg(F.round(F.avg("propensity"), 9).alias("mean_propensity"))))  # one row each


@query("seen_filter_logged", f"WITH {BLEND_SQL}, shown AS (SELECT user_id AS request, item_id AS item, min(ts) AS first FROM clicks_ev GROUP BY user_id, item_id) SELECT b.request, b.item FROM blended b JOIN req USING (request) WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.request = b.request AND s.item = b.item AND s.first < req.ts)")
def seen_filter_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = blended(spark, sf_dir).join(requests(spark, sf_dir), "request").select("request", "item", "ts", F.col("request").alias("user_id"))
    shown = clicks_ev(spark, sf_dir).select("user_id", F.col("item_id").alias("item"), "ts")
    return candidates.seen_filter(asked, shown).select("request", "item")


@query("bloom_sizing", "SELECT n::BIGINT AS capacity, ceil(-n * ln(0.01) / pow(ln(2), 2))::BIGINT AS bits, greatest(1, round(ceil(-n * ln(0.01) / pow(ln(2), 2)) / n * ln(2)))::INTEGER AS hashes FROM (VALUES (50), (200), (1000)) AS t(n)")
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits, hashes = candidates.bloom_size(F.col("capacity"), 0.01)
    return spark.createDataFrame([(50,), (200,), (1000,)], "capacity long").select("capacity", bits.alias("bits"), hashes.alias("hashes"))


@query(
    "bloom_membership",
    f"""WITH {CLICKS_EV}, seen AS (SELECT DISTINCT user_id, item_id FROM clicks_ev WHERE item_id IS NOT NULL),
n AS (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id), b AS (SELECT user_id, n, ceil(-n * ln(0.01::DOUBLE) / pow(ln(2::DOUBLE), 2))::BIGINT AS bits FROM n),
sizes AS (SELECT user_id, bits, greatest(1, round(bits / n * ln(2::DOUBLE)))::INTEGER AS hashes FROM b),
items AS (SELECT DISTINCT item_id FROM seen), every AS (SELECT item_id FROM items UNION ALL SELECT item_id + (SELECT max(item_id) - min(item_id) + 1 FROM items) FROM items),
h AS (SELECT user_id, item_id, bits, hashes, ('0x' || substr(md5(user_id::VARCHAR || ':' || item_id::VARCHAR || ':a'), 1, 8))::BIGINT AS x, ('0x' || substr(md5(user_id::VARCHAR || ':' || item_id::VARCHAR || ':b'), 1, 8))::BIGINT | 1 AS y FROM sizes, every),
spots AS (SELECT user_id, item_id, (x + i * y) % bits AS bit FROM h, unnest(range(0, hashes)) AS t(i)),
sets AS (SELECT DISTINCT user_id, bit FROM spots SEMI JOIN seen USING (user_id, item_id)),
told AS (SELECT user_id, item_id, bool_and(sets.bit IS NOT NULL) AS called FROM spots LEFT JOIN sets USING (user_id, bit) GROUP BY user_id, item_id)
SELECT count(*) FILTER (s.item_id IS NOT NULL AND NOT called) AS missed, round(avg(CASE WHEN s.item_id IS NULL THEN called::INTEGER::DOUBLE END), 9) AS false_positive_rate FROM told LEFT JOIN seen s USING (user_id, item_id)""",
)
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's seen list as a bit set, and the rate at which items not in it are called seen: every item of the log and as many others are asked of every user.

    A bit set is an array of words, so an item is looked up where its bits lie. What is called of all
    items and of the user's own are counted apart, so the pairs of users and items are never joined.
    """
    seen = staged(clicks_ev(spark, sf_dir).where("item_id is not null").select("user_id", "item_id").distinct(), "bloom-seen")
    bits, hashes = candidates.bloom_size(F.col("n"), 0.01)
    sizes = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", bits.alias("bits"), hashes.alias("hashes"))
    spots = candidates.bloom_positions(F.col("user_id"), F.col("item_id"), F.col("bits"), F.col("hashes"))
    words = seen.join(sizes, "user_id").select("user_id", "bits", "hashes", F.explode(spots).alias("bit"))
    words = words.groupBy("user_id", "bits", "hashes", F.floor(F.col("bit") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("word"))
    sets = words.groupBy("user_id", "bits", "hashes").agg(candidates.bit_words(F.col("bits")).alias("words"))
    sets = staged(sets, "bloom-sets")
    called = F.forall(spots, lambda x: candidates.bit_set(F.col("words"), x))
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(f"{name}_n"), F.count_if(called).alias(f"{name}_called"))
    own = count(seen.join(sets, "user_id"), "own")
    # Few bytes make many rows: both sides are dealt out by number, as the planner goes by bytes and sends one of them whole.
    tasks = 4 * spark.sparkContext.defaultParallelism
    told = count(sets.repartition(tasks, "user_id").crossJoin(asked_items(spark, sf_dir).repartition(tasks, "item_id")), "every").join(F.broadcast(own))  # one row each
    others = F.try_divide((F.col("every_called") - F.col("own_called")).cast("double"), F.col("every_n") - F.col("own_n"))
    return told.select((F.col("own_n") - F.col("own_called")).alias("missed"), F.round(others, 9).alias("false_positive_rate"))


@query(
    "batch_recommend",
    f"""WITH {BLEND_SQL}, shown AS (SELECT user_id AS request, item_id AS item, min(ts) AS first FROM clicks_ev GROUP BY user_id, item_id),
kept AS (SELECT b.* FROM blended b JOIN req USING (request) WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.request = b.request AND s.item = b.item AND s.first < req.ts)),
o AS (SELECT *, row_number() OVER (PARTITION BY request, item % 8 ORDER BY position, item) > 2 AS over FROM kept),
slates AS (SELECT request, item, place AS position FROM (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY over, position, item)::INTEGER AS place FROM o) WHERE place <= 6)
SELECT request, item, position, false AS degraded FROM slates UNION ALL SELECT request, item, rank, true FROM s_trend WHERE rank <= 6 AND request NOT IN (SELECT request FROM slates)""",
)
def batch_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieve, blend, drop what was seen, score, re-rank; a request left without candidates gets the popular items."""
    asked = blended(spark, sf_dir).join(requests(spark, sf_dir), "request").withColumn("user_id", F.col("request"))
    left = candidates.seen_filter(asked, clicks_ev(spark, sf_dir).select("user_id", F.col("item_id").alias("item"), "ts"))
    # Without a ranker the retrieval order is the score.
    ranked = left.withColumn("score", F.lit(1.0) / (F.col("position") + 1)).select("request", "item", "score", (F.col("item") % 8).cast("string").alias("category"))
    slates = candidates.capped(ranked, 6, 2).select("request", "item", "position")
    empty = requests(spark, sf_dir).select("request").join(slates.select("request").distinct(), "request", "left_anti")
    fallback = trending(spark, sf_dir).where("rank <= 6").join(empty, "request").select("request", "item", F.col("rank").alias("position"))
    return slates.withColumn("degraded", F.lit(False)).unionByName(fallback.withColumn("degraded", F.lit(True)))
