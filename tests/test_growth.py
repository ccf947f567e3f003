"""Tasks that stay as small as they are when tables grow, and odd rows on the way."""

import math
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur import registry
from larkspur.functions.columns import digest_uniform
from larkspur.operators import candidates, inference, quantised, scoring
from larkspur.sources import shared, views

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def twice(sf_dir, tmp_path_factory):
    """The tables with every part listed twice."""
    at = str(tmp_path_factory.mktemp("twice"))
    for t in os.listdir(sf_dir):
        if t != "part.parquet":
            os.symlink(f"{sf_dir}/{t}", f"{at}/{t}")
    duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/part.parquet' UNION ALL SELECT * FROM '{sf_dir}/part.parquet') TO '{at}/part.parquet' (FORMAT parquet)")
    return at


def same_as_sql(spark, at, name):
    con = duckdb.connect()
    for t in os.listdir(at):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{at}/{t}'")
    df = QUERIES[name](spark, at)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", ["table_contracts", "data_contracts", "request_tensors", "model_table", "cohort_report"])
def test_a_part_listed_twice_is_one_item_of_a_slate(spark, twice, name):
    same_as_sql(spark, twice, name)


@pytest.mark.parametrize("catalogued", [True, False])
def test_tasks_of_slates_grow_in_number(spark, sf_dir, monkeypatch, catalogued):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    rows = views.slates_li(spark, sf_dir, catalogued)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert rows.rdd.getNumPartitions() == -(-n // 100)
    assert "hashpartitioning(impression_id" not in rows.groupBy("impression_id").count()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tokenize", "tfidf_weights"])
def test_texts_are_dealt_and_not_their_terms(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id#" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(doc_id" in line and "term#" in line]


def test_the_hash_of_a_bootstrap_counts_as_its_number_does(spark):
    u = digest_uniform(F.col("id").cast("string"), F.lit("7"))
    want = sum(((u >= c).cast("int") for c in inference._poisson_one()[:8]), F.lit(0))
    rows = spark.range(20_000).select(want.alias("a"), inference.poisson_weight(F.col("id"), F.lit(7)).alias("b"))
    assert rows.where("a <> b").count() == 0 and rows.agg(F.max("b")).first()[0] >= 5
    assert inference.poisson_weight(F.lit("x"), F.lit(1))._jc.toString().count("conv(") == 0


def test_a_bootstrap_of_impressions_is_dealt(spark, sf_dir):
    assert "hashpartitioning(event_id" in QUERIES["bootstrap_impressions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_content_scores_are_dealt_by_user_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    df = QUERIES["content_score"](spark, sf_dir)
    assert df.rdd.getNumPartitions() > 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"hashpartitioning\(user_id[^)]*\)", plan))) == 1 and "hashpartitioning(impression_id" not in plan
    same_as_sql(spark, sf_dir, "content_score")


def test_content_scores_of_rows_without_user_or_item(spark):
    rows = [(1, 7, 1, True, 10), (2, 7, 2, False, 20), (2, 7, 2, False, 20), (3, None, 1, True, 10), (4, None, 1, False, 20), (5, 7, None, False, 30), (6, 7, 9, False, 30), (7, 7, 1, False, None)]
    rows = spark.createDataFrame(rows, "impression_id long, user_id long, item_id long, clicked boolean, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    catalogue = spark.createDataFrame([(1, "red bolt"), (2, "red ring"), (3, "blue plate")], "item_id long, title string")
    got = scoring.content(rows, rows.where("false"), catalogue)
    red, rare = math.log(3 / 2), math.log(3)
    cosine = red**2 / (red**2 + rare**2)
    assert got.columns == [*rows.columns, "score"]
    assert sorted((r["impression_id"], r["score"]) for r in got.collect()) == [(1, 0.0), (2, pytest.approx(cosine)), (2, pytest.approx(cosine)), (3, 0.0), (4, 0.0), (5, 0.0), (6, 0.0), (7, 0.0)]


def test_replayed_requests_are_dealt_by_user_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    df = QUERIES["seen_replay"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() > 4
    assert len(set(re.findall(r"hashpartitioning\(user_id[^)]*\)", plan))) == 1 and "hashpartitioning(request" not in plan
    same_as_sql(spark, sf_dir, "seen_replay")


def test_replay_of_ranked_requests(spark):
    rows = [(1, 10, 5, [1, 2, 3]), (1, 11, 6, [3, 2, 1]), (1, 12, 7, [2, 1]), (2, 13, 1, []), (2, 14, 2, [7])]
    requests = spark.createDataFrame(rows, "user_id long, request long, s long, items array<long>").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
    got = candidates.replay_ranked(requests, lambda r: r.withColumn("pool", F.col("items")), 2).collect()
    assert sorted(map(tuple, got)) == [(10, 0, 1, 0), (10, 1, 2, 0), (11, 0, 3, 2), (12, 0, 2, 2), (12, 1, 1, 2), (14, 0, 7, 0)]


@pytest.fixture(scope="module")
def catalogue(spark):
    """1,300 items, some of equal vectors, 90 requests and pairs of both: near ones, far ones, and some without vectors."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1300, 16))
    v[1250:] = v[:50]
    q = np.concatenate([v[:60] + rng.normal(size=(60, 16)), rng.normal(size=(30, 16))])
    frame = lambda rows, name: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], f"{name} long, vector array<double>").cache()
    pairs = [(i, j) for i in range(60) for j in (i, i + 1250, i + 1)] + [(i, int(j)) for i in range(95) for j in rng.integers(0, 1400, 2)]
    return frame(q, "request"), frame(v, "item"), spark.createDataFrame(sorted({*pairs}), "request long, item long").cache()


@pytest.mark.parametrize("kind", ["exact", "index"])
def test_pairs_are_listed_as_whole_lists_say_but_few_requests_ask_all_items(spark, catalogue, monkeypatch, kind):
    """The lists of some lots rule out most pairs, so that not every request meets every item."""
    monkeypatch.setattr(quantised, "LOT", 40)
    asked, items, pairs = catalogue
    lots, search = candidates.exact_lists(items, 5, 40) if kind == "exact" else quantised.lists(asked, items, 5)
    met = []
    told = candidates.listed(candidates.scored_pairs(pairs, asked, items), asked, 5, (lots, lambda q, some: met.append((some, q.count())) or search(q, some)))
    want = pairs.join(search(asked, lots).select("request", "item"), ["request", "item"])
    got = told.select("request", "item")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count() >= 20
    assert lots == 33 and [some for some, _ in met] == [1, 8, 33]
    assert met[0][1] == 90 > met[1][1] > met[2][1] >= want.select("request").distinct().count()


def test_click_recall_is_that_of_whole_lists(spark, sf_dir, monkeypatch):
    at = QUERIES["ann_click_recall"].__wrapped__.__globals__
    exact = candidates.exact_lists
    monkeypatch.setattr(candidates, "exact_lists", lambda items, k, rows=30: exact(items, k, rows))
    monkeypatch.setattr(quantised, "LOT", 60)
    row = QUERIES["ann_click_recall"](spark, sf_dir).first()
    asked, items, clicked = at["mean_vectors"](spark, sf_dir), at["_items"](spark, sf_dir), at["truth"](spark, sf_dir)
    clicked = clicked.join(asked.select("request"), "request").join(items.select("item"), "item")
    assert row["clicks"] == clicked.count() > 0
    for name, found in (("exact", candidates.knn_exact(asked, items, 10)), ("index", quantised.knn_ivfpq(asked, items, 10))):
        n = clicked.join(found, ["request", "item"]).count()
        assert row[f"{name}_hits"] == n > 0 and row[f"{name}_recall"] == pytest.approx(n / row["clicks"])


def test_small_cells_are_scored_together():
    """Calls are bounded by tiles; with one call a cell, an index took twenty times as long as all products."""
    rng = np.random.default_rng(4)
    v, q, centres, calls = rng.normal(size=(900, 8)), rng.normal(size=(70, 8)), rng.normal(size=(300, 8)), []
    scorer = lambda tile, near: lambda rows, places, cells: calls.append(1) or tile[rows] @ v[places].T
    found = list(candidates.probed(scorer, q, centres, 90, (v @ centres.T).argmax(1), rng.permutation(900), 12))
    assert len(calls) == 1 and sum(len(f[0]) for f in found) == 12 * 70


def test_no_task_a_cell_learns_centres(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 32)) * 9
    rows = middle[np.arange(1600) % 20] + rng.normal(size=(1600, 32)) * 0.1
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "item long, vector array<double>").cache()
    context = spark.sparkContext
    context.setJobGroup("cells", "cells")
    wide = candidates.ivf_cells(v, 300)[0]
    context.setJobGroup("rest", "rest")
    told = context.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("cells") for s in told.getJobInfo(j).stageIds]
    assert 200 < len(wide) <= 300 and max(s.numTasks for s in stages if s) < 100
    centres, placed = candidates.ivf_cells(v, 20)
    # Far groups are found, each whole.
    assert len(centres) == 20 and np.allclose(np.linalg.norm(centres, axis=1), 1)
    own = placed.groupBy((F.col("item") % 20).alias("g")).agg(F.count_distinct("cell").alias("n")).collect()
    assert [r["n"] for r in own] == [1] * 20
    equal = spark.range(200).select(F.col("id").alias("item"), F.array(F.lit(3.0), F.lit(4.0)).alias("vector"))
    assert np.allclose(candidates.ivf_cells(equal, 9)[0], [[0.6, 0.8]])


@pytest.mark.parametrize(("probes", "most"), [(30, 12), (9, 12), (9, 400)])
def test_a_floor_leaves_what_a_search_without_it_finds_above(monkeypatch, probes, most):
    monkeypatch.setattr(quantised, "TILE_Q", 7)
    rng = np.random.default_rng(2)
    v, q, centres, books = rng.normal(size=(900, 8)), rng.normal(size=(70, 8)), rng.normal(size=(30, 8)), rng.normal(size=(2, 256, 4))
    v[700:] = v[:200]
    cell = (v @ centres.T).argmax(1)
    code = quantised.encoded(v - centres[cell], books)
    lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    there = pa.table({"item": rng.permutation(900), "cell": cell, "code": pa.array([c.tobytes() for c in code], pa.binary()), "vector": lists(v)})
    asked = lambda floor: pa.table({"request": np.arange(70), "vector": lists(q), "floor": pa.array(floor, pa.float64())})
    best = quantised._best(centres, books, 10, probes, most)
    every = best(asked(np.full(70, -np.inf)), there).to_pylist()
    floor = np.where(np.arange(70) % 5 > 0, [sorted((f["score"] for f in every if f["request"] == r), reverse=True)[r % 10] for r in range(70)], -np.inf)
    got = best(asked(floor), there).to_pylist()
    told = lambda rows: sorted((f["request"], f["item"], f["score"]) for f in rows)
    assert told(got) == told(f for f in every if f["score"] >= floor[f["request"]]) and 70 < len(got) < len(every)
