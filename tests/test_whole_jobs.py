"""Queries whose results have to hold the whole of a larger or odder table."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from larkspur import registry
from larkspur.operators import candidates, measure, quantised
from larkspur.sources.views import clicks_ev
from larkspur.streaming import streams

QUERIES = registry.queries()


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_index(spark, size):
    at = f"/root/testdata/{size}"
    got = QUERIES["ann_index_agreement"](spark, at)
    row = got.agg(F.count(F.lit(1)).alias("n"), F.avg("agreement").alias("mean")).first()
    assert row["n"] == spark.read.parquet(f"{at}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert 0.9 <= row["mean"] <= 1


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """An event log of three users and 600 items, most of them above 200."""
    at = str(tmp_path_factory.mktemp("wide"))
    rows = spark.range(6000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_705_700_000) + F.col("id")).alias("ts"), (F.col("id") % 3).alias("user_id"),
        F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"), F.format_string('{"k": %d}', F.col("id") * 7 % 600).alias("props"),
    )
    rows.write.parquet(f"{at}/events.parquet")
    return at


def test_every_item_is_looked_up(spark, wide):
    rows = {r["item_id"]: r for r in QUERIES["online_lookup"](spark, wide).collect()}
    assert set(rows) == set(range(1200))
    assert any(rows[i]["item_impressions_24h"] for i in range(200, 600)) and not any(rows[i]["found"] for i in range(600, 1200))


def test_filters_hold_every_item_of_a_long_list(spark, wide):
    row = QUERIES["bloom_membership"](spark, wide).first()
    assert row["missed"] == 0 and row["false_positive_rate"] < 0.03


def test_catalogue_of_the_exposure_windows(spark, wide):
    rows = QUERIES["exposure_windows"](spark, wide).collect()
    assert len(rows) == 6
    for r in rows:
        # 600 items shown once or twice among 1,200
        x = sorted([0] * 600 + [1] * (2 * 600 - 1000) + [2] * (1000 - 600))
        want = sum((2 * i - 1200 - 1) * v for i, v in enumerate(x, 1)) / (1200 * 1000)
        assert r["distinct_items"] == 600 and abs(r["gini_catalogue"] - want) < 1e-8


def test_bands_pair_users(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 1), (2, 0, 1, 0), (2, 30, 0, 1), (3, 600, 0, 0)], "user_id long, x long, a int, b int")
    got = {r["band"]: tuple(r)[1:] for r in measure.band_users(rows, (0, 2, 5, 10, 25, 50))[0].collect()}
    assert got["0"] == got["<26"] == (3, 2, 2 / 3, 2 / 3, (0.5 - 1) / 2)
    assert got["26-50"] == (1, 1, 0.0, 1.0, 1.0) and got["51+"] == (1, 1, 0.0, 0.0, 0.0)
    assert got["overall"] == (5, 3, 0.4, 0.6, pytest.approx(0.5 / 3))


def test_bands_are_of_the_clicked_items(spark, sf_dir):
    rows = {r["band"]: r for r in QUERIES["band_compare_users"](spark, sf_dir).collect()}
    alone = {r["band"]: r for r in QUERIES["popularity_bands"](spark, sf_dir).collect()}
    alone["overall"] = alone.pop("all")
    assert set(rows) - {"<26"} == set(alone)
    for band, r in alone.items():
        assert rows[band]["n_rows"] == r["n_rows"] and rows[band]["mean_a"] == pytest.approx(r["recall"])
    assert all(r["lo"] <= r["mean_difference"] <= r["hi"] for r in rows.values() if r["users"] >= 30)


def test_running_session_beyond_the_ring(spark):
    i = F.col("id")
    # 130 clicks a minute apart, then a new session of user 2; user 1's click 70 is the latest to arrive.
    clicks = spark.range(130).select(
        F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("user_id"), i.alias("item_id"), F.when(i < 40, F.concat(F.lit("c"), i.cast("string"))).otherwise("rest").alias("category"),
        F.lit(True).alias("clicked"), F.timestamp_seconds(F.lit(1_700_000_000) + 60 * i).alias("ts"),
    )
    clicks = clicks.withColumn("ts", F.when((F.col("user_id") == 2) & (F.col("item_id") >= 70), F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")))
    clicks = clicks.withColumn("arrives", F.when((F.col("user_id") == 1) & (F.col("item_id") == 70), F.col("ts") + F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts")))
    got = streams.drained(streams.recent_items(streams.replay(clicks, "arrives")), "update", "beyond", ["user_id"], "version")
    rows = {r["user_id"]: r for r in got.collect()}
    assert (rows[1]["session_length"], rows[1]["session_categories"]) == (130, 41)
    assert (rows[2]["session_length"], rows[2]["session_categories"]) == (60, 1)
    assert rows[1]["last_items"] == rows[2]["last_items"] == list(range(129, 79, -1))


def _two_waves(spark, chunks=2):
    """3,000 users with two showings of each of two items, and one user without an id; a null item is shown, too."""
    rows = spark.range(12_000).select(
        F.when(F.col("id") % 12_000 != 7, F.col("id") % 3000).alias("user_id"), F.when(F.col("id") != 11, F.col("id") % 2).alias("item_id"), F.lit("c").alias("category"), F.lit(True).alias("clicked"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 3000) * 60).alias("ts"),
    )
    return rows, streams.replay(rows, "ts", chunks).withWatermark("ts", streams.LATENESS)


def _state_rows(monkeypatch):
    """The most rows of keyed state that streams started from here on hold."""
    queries, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: queries.append(start(self, *a, **k)) or queries[-1])
    return lambda: max(o["numRowsTotal"] for q in queries for p in q.recentProgress for o in p["stateOperators"])


def test_seen_items_share_the_state_of_a_bucket(spark, monkeypatch):
    """Calls of Python are bounded by buckets, not by pairs of user and item."""
    rows, stream = _two_waves(spark)
    state = _state_rows(monkeypatch)
    told = streams.drained(streams.unseen(stream, buckets=16), "append", "shared").groupBy("user_id", "item_id", "ts").agg(F.max_by("seen", "version").alias("seen"))
    assert state() <= 4 * 16
    rows.createOrReplaceTempView("waves")
    want = spark.sql("""SELECT user_id, item_id, ts, coalesce(unix_micros(ts) - unix_micros(lag(ts) OVER (PARTITION BY user_id, item_id ORDER BY ts)) <= 7 * 86400000000, false) AS seen
        FROM (SELECT DISTINCT user_id, item_id, ts FROM waves)""")
    assert told.exceptAll(want).isEmpty() and want.exceptAll(told).isEmpty()


def test_recent_items_share_the_state_of_a_bucket(spark, monkeypatch):
    rows, stream = _two_waves(spark)
    state = _state_rows(monkeypatch)
    got = streams.drained(streams.recent_items(stream, ttl_seconds=86_400, buckets=16), "update", "shared", ["user_id"], "version").select("user_id", "last_items", "session_length")
    assert state() <= 2 * 16
    listed = F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("ts", F.col("item_id").isNotNull().alias("known"), "item_id")))), lambda x: x["item_id"])
    want = rows.groupBy("user_id").agg(listed.alias("last_items"), F.count(F.lit(1)).alias("session_length"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 3001


def test_probed_cells_are_searched_whole(monkeypatch):
    """Scores of many cells are merged a few at a time; what comes out is the best of all that the probed cells hold."""
    rng = np.random.default_rng(4)
    v, q, centres = rng.normal(size=(900, 8)), rng.normal(size=(70, 8)), rng.normal(size=(30, 8))
    v[800:] = v[0]
    cell, item = (v @ centres.T).argmax(1), rng.permutation(900)
    for name, value in (("TILE_Q", 32), ("TILE_I", 50), ("WAITING", 500)):
        monkeypatch.setattr(candidates, name, value)
    scorer = lambda tile, near: lambda rows, places, c: candidates._products(tile[rows], v[places])
    got = [np.concatenate(x) for x in zip(*candidates.probed(scorer, q, centres, 9, cell, item, 12), strict=True)]
    for r in range(len(q)):
        near = np.isin(cell, np.argsort(-(centres @ q[r]))[:9])
        want = sorted((-round(float(s), 9), int(i)) for s, i in zip(v[near] @ q[r], item[near], strict=True))[:12]
        assert item[got[1][got[0] == r]].tolist() == [i for _, i in want]


def test_an_index_sends_on_k_rows_a_query_and_lot(spark, monkeypatch):
    """However many cells a query looks into: with rows a query and cell, large indexes filled the disk."""
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(800, 8)))], "item long, vector array<double>")
    asked = v.where("item < 20").withColumnRenamed("item", "request")
    sent, top = [], candidates.top_k
    for module in (candidates, quantised):
        monkeypatch.setattr(module, "top_k", lambda rows, k, *a, **b: sent.append(rows.count()) or top(rows, k, *a, **b))
    exact = {(r["request"], r["item"]) for r in candidates.knn_exact(asked, v, 5).collect()}
    for found in (candidates.knn_ivf(asked, v, 5, cells=16, probes=16), quantised.knn_ivfpq(asked, v, 5, parts=2, cells=16, probes=16)):
        assert len(exact & {(r["request"], r["item"]) for r in found.collect()}) >= 0.9 * len(exact)
    assert sent == [100, 100, 100]


def test_filters_are_asked_for_every_item(spark, sf_dir, tmp_path, monkeypatch):
    """Every user's filter is asked for every item of the log and as many others, and a bit set is as a list of bits says."""
    asked, whole = [], registry.queries()["bloom_membership"].__wrapped__.__globals__["asked_items"]
    monkeypatch.setitem(registry.queries()["bloom_membership"].__wrapped__.__globals__, "asked_items", lambda *a: asked.append(whole(*a)) or asked[-1])
    row = QUERIES["bloom_membership"](spark, sf_dir).first()
    assert row["missed"] == 0
    clicks = clicks_ev(spark, sf_dir)
    assert [a.count() for a in asked] == [2 * clicks.select("item_id").distinct().count()]
    rows = spark.createDataFrame([(0, (1 << 62) | 1), (2, -(1 << 63))], "at int, word long").withColumn("bits", F.lit(200))
    got = rows.agg(candidates.bit_words(F.col("bits")).alias("w")).select(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: candidates.bit_set(F.col("w"), i)).alias("x")).first()["x"]
    assert [i for i, x in enumerate(got) if x] == [0, 62, 191]
