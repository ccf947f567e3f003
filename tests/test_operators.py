"""Small hand-made cases of the operators' rules."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from larkspur.functions import columns
from larkspur.operators import candidates, contracts, dictionary, dump, features, inference, measure, monitor, online, quantised, ranges, scoring, timeline, transform
from larkspur.operators.timeline import Series
from larkspur.sources import logs
from larkspur.streaming import streams

T0 = datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# as-of


def labels(spark, rows):
    return frame(spark, rows, "impression_id long, item_id string, ts timestamp")


def series(spark, rows):
    return Series(frame(spark, rows, "item_id string, feature_ts timestamp, ctr double"), ("item_id",), "feature_ts", ("ctr",))


def test_asof_boundaries(spark):
    rows = [(1, "a", at(0)), (2, "a", at(10)), (3, "a", at(9)), (4, "b", at(99)), (5, None, at(99)), (6, "a", at(50))]
    got = timeline.attach_asof(labels(spark, rows), series(spark, [("a", at(10), 0.5), ("a", at(20), None), ("c", at(0), 0.9), (None, at(0), 0.7)]))
    assert {r["impression_id"]: r["ctr"] for r in got.collect()} == {1: None, 2: 0.5, 3: None, 4: None, 5: None, 6: 0.5}


def test_asof_refuses_a_clash(spark):
    with pytest.raises(ValueError, match="already there"):
        timeline.attach_asof(labels(spark, [(1, "a", at(0))]).withColumn("ctr", F.lit(1.0)), series(spark, []))


def test_asof_keeps_repeated_labels(spark):
    got = timeline.attach_asof(labels(spark, [(1, "a", at(5))] * 3), series(spark, [("a", at(5), 0.1)]))
    assert [r["ctr"] for r in got.collect()] == [0.1] * 3


def test_asof_of_a_hot_key_is_cut_into_ranges(spark):
    """All labels have one category, and a few items: both ways agree, and no sort sees more than a range of a key."""
    rng = random.Random(4)
    rows = [(n, rng.choice(["a", "b", None]), at(rng.randrange(400))) for n in range(600)]
    label = labels(spark, rows).withColumn("category", F.when(F.col("ts") < F.lit(at(390)), "c"))
    one = series(spark, [(rng.choice(["a", "b", None]), at(rng.randrange(400)), rng.choice([None, 0.1, 0.2, 0.3])) for _ in range(90)])
    one = Series(one.rows.groupBy("item_id", one.ts).agg(F.max("ctr").alias("ctr")), one.keys, one.ts, one.columns)
    more = frame(spark, [("c", "a" if n % 2 else "b", at(n * 13), n if n % 3 else None, float(n)) for n in range(30)], "category string, item_id string, since timestamp, x int, y double")
    two = Series(more.select("category", "since", F.col("x").alias("cx"), F.col("y").alias("cy")), ("category",), "since", ("cx", "cy"))
    three = Series(more, ("category", "item_id"), "since", ("x", "y"))
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = told(timeline.attach_asof(label, one, two, three))
    for hot, width in ((1, 5), (100, 60), (250, 10_000)):
        got = timeline.attach_asof(label, one, two, three, hot_rows=hot, range_seconds=width)
        assert told(got) == want
    plan = timeline.attach_asof(label, two, hot_rows=1, range_seconds=5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "__row" not in line and "windowspecdefinition(category" in line]
    assert any("__range" in line.split("windowspecdefinition(")[1].split("__at")[0] for line in windows)


def test_asof_shares_one_exchange(spark):
    rows = frame(spark, [(1, "u", "c", at(5))], "impression_id long, user_id string, category string, ts timestamp")
    one = Series(frame(spark, [("u", at(1), 1)], "user_id string, f timestamp, a int"), ("user_id",), "f", ("a",))
    two = Series(frame(spark, [("u", "c", at(2), 2)], "user_id string, category string, f timestamp, b int"), ("user_id", "category"), "f", ("b",))
    got = timeline.attach_asof(rows, one, two)
    assert got.first().asDict()["a"] == 1 and got.first().asDict()["b"] == 2
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 2
    executed = got._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1


# sessions and gaps


def test_sessions(spark):
    rows = [("u", at(0)), ("u", at(1800)), ("u", at(3601)), ("u", at(3601)), ("v", at(0))]
    got = timeline.sessionize(frame(spark, rows, "user_id string, ts timestamp")).collect()
    assert sorted((r["user_id"], r["ts"], r["session_id"]) for r in got) == [("u", at(0), "u#1"), ("u", at(1800), "u#1"), ("u", at(3601), "u#2"), ("u", at(3601), "u#2"), ("v", at(0), "v#1")]
    with pytest.raises(ValueError):
        timeline.sessionize(frame(spark, rows, "user_id string, ts timestamp"), 0)


# series


def test_a_bucket_is_visible_only_when_closed(spark):
    rows = [(1, "a", "c", False, datetime(2024, 1, 1, 13, 10))] + [(i, "a", "c", True, datetime(2024, 1, 1, 14, 50)) for i in range(2, 102)]
    events = frame(spark, rows, "impression_id long, item_id string, category string, clicked boolean, ts timestamp")
    hourly = features.hourly(events, features.ITEM)
    label = frame(spark, [("a", datetime(2024, 1, 1, 14, 5))], "item_id string, ts timestamp")
    got = timeline.attach_asof(label, Series(hourly, ("item_id",), "feature_ts", ("item_impressions_cum", "item_clicks_cum"))).first()
    assert (got["item_impressions_cum"], got["item_clicks_cum"]) == (1, 0)


def test_the_day_has_both_ends(spark):
    rows = [(i, "a", "c", True, datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(30)]
    got = features.hourly(frame(spark, rows, "impression_id long, item_id string, category string, clicked boolean, ts timestamp"), features.ITEM).orderBy("feature_ts").collect()
    assert got[-1]["item_clicks_24h"] == 25 and got[-1]["item_clicks_cum"] == 30 and got[-1]["item_age_hours"] == 29


def test_thin_categories_take_the_global_rate(spark):
    rows = [("x", "big", at(0), 100, 50), ("y", "small", at(0), 2, 2)]
    hourly = frame(spark, rows, "item_id string, category string, feature_ts timestamp, item_impressions_1h long, item_clicks_1h long")
    got = {r["category"]: r["cat_expanding_ctr"] for r in features.category_prior(hourly, 10).collect()}
    assert got == {"big": 0.5, "small": pytest.approx(52 / 102)}


# histories and negatives


def test_history_sees_earlier_seconds_only(spark):
    asked = frame(spark, [(1, "u", at(10)), (2, "u", at(10)), (3, "u", at(11)), (4, "v", at(50)), (5, "u", at(9))], "impression_id long, user_id string, ts timestamp")
    clicks = frame(spark, [("u", at(10), 7), ("u", at(9), 3), ("u", at(9), 5), ("u", at(8), 1)], "user_id string, ts timestamp, item_idx int")
    got = {r["impression_id"]: r["inwindow_idx"] for r in timeline.clicks_before(asked, clicks, 3).collect()}
    assert got == {1: [5, 3, 1], 2: [5, 3, 1], 3: [7, 5, 3], 4: [], 5: [1]}
    snap = frame(spark, [("u", [100, 101], 2)], "user_id string, snapshot_idx array<int>, snapshot_len int")
    rows = {r["impression_id"]: r for r in timeline.user_history(asked, timeline.clicks_before(asked, clicks, 3), snap, 4).collect()}
    assert rows[5]["history_idx"] == [1, 100, 101] and rows[3]["history_idx"] == [7, 5, 3, 100] and rows[4]["has_history"] is False and len(rows) == 5


def test_snapshots_are_most_recent_first(spark):
    rows = frame(spark, [("u", "a b zz c"), ("v", ""), ("w", None)], "user_id string, history string")
    items = frame(spark, [("a", 1), ("b", 2), ("c", 3)], "item_id string, item_idx int")
    assert [(r["user_id"], r["snapshot_idx"]) for r in timeline.snapshot_history(rows, items).collect()] == [("u", [3, 2, 1])]


def test_negatives_are_prefixes(spark):
    rows = [(1, f"i{k}", k == 3, k) for k in range(9)] + [(2, "a", True, 1)]
    events = frame(spark, rows, "impression_id long, item_id string, clicked boolean, item_idx int")
    long, short = ({r["impression_id"]: r["neg_idx"] for r in transform.slate_negatives(df, n).collect()} for df, n in ((events, 20), (events.repartition(5), 4)))
    assert set(long) == {1} and len(long[1]) == 8 and 3 not in long[1] and short[1] == long[1][:4]


# logs


def test_behaviours_to_events(spark, tmp_path):
    (tmp_path / "b.tsv").write_text('1\tu1\t11/9/2019 9:05:58 AM\t\tN4-1 N-5-0\n2\tu"2\t11/9/2019 12:00:00 PM\tN1 N2\tN3-0\n')
    raw = logs.read_behaviours(spark, str(tmp_path / "b.tsv"))
    assert [r["history"] for r in raw.orderBy("impression_id").collect()] == [None, "N1 N2"]
    got = [(r["impression_id"], r["user_id"], r["item_id"], r["clicked"], r["slot"], r["ts"].hour) for r in logs.to_events(raw).orderBy("impression_id", "slot").collect()]
    assert got == [(1, "u1", "N4", True, 0, 9), (1, "u1", "N-5", False, 1, 9), (2, 'u"2', "N3", False, 0, 12)]


def test_catalogues_join_once(spark, tmp_path):
    for n, lines in (("a", "N1\tnews\tx\tTitle\t\tu\t[]\t[]\n"), ("b", "N1\tnews\tx\tTitle\t\tu\t[]\t[]\nN2\tsport\ty\tOther\tabs\tu\t[]\t[]\n")):
        (tmp_path / n).write_text(lines)
    got = logs.read_catalogue(spark, [str(tmp_path / n) for n in "ab"]).orderBy("item_id").collect()
    assert [(r["item_id"], r["abstract"]) for r in got] == [("N1", None), ("N2", "abs")]


def test_partitions_and_markers(spark, tmp_path):
    path = str(tmp_path / "out")
    assert not logs.is_built(spark, path)
    logs.write_partitioned(frame(spark, [(1, "d1"), (2, "d2")], "x int, dt string"), path)
    assert logs.is_built(spark, path) and (tmp_path / "out/dt=d1").exists()


def test_noisy_json(spark):
    lines = frame(spark, [('x {"a": 1}',), ("none",), ("{broken",)], "value string")
    assert [r["a"] for r in logs.from_json_lines(lines, "a int").collect()] == [1, None] or [r["a"] for r in logs.from_json_lines(lines, "a int").collect()] == [1]


# ids


def test_dense_ids(spark):
    got = transform.dense_ids(frame(spark, [(f"k{i % 37:02d}",) for i in range(200)] + [(None,)], "k string"), "k", "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 38))


# scorers


def clicks(spark, rows):
    return frame(spark, rows, "impression_id long, user_id string, item_id string, clicked boolean, ts timestamp")


def test_decay_against_the_sum(spark):
    rng = random.Random(1)
    hits = [(i, "u", rng.choice("ab"), True, at(rng.random() * 90 * 86400)) for i in range(200)]
    asked = [(1000 + i, "u", rng.choice("abz"), False, at(rng.random() * 90 * 86400)) for i in range(60)]
    for half_life in (0.02, 3.0):
        got = {r["impression_id"]: r["score"] for r in scoring.decayed(clicks(spark, asked), clicks(spark, hits), half_life).collect()}
        for i, _, item, _, ts in asked:
            ages = [(math.floor(ts.timestamp()) - math.floor(h[4].timestamp())) / 86400 for h in hits if h[2] == item and h[4] < ts]
            assert got[i] == pytest.approx(sum(math.exp(-math.log(2) / half_life * a) for a in ages), rel=1e-9, abs=1e-200)
        assert len(got) == 60


def test_scores_are_strictly_before(spark):
    hit, asked = [(1, "u", "a", True, at(0))], [(2, "u", "a", False, at(0)), (3, "u", "a", False, at(86400)), (4, "u", "b", False, at(9))]
    for score, want in ((scoring.decayed(clicks(spark, asked), clicks(spark, hit), 1.0), {2: 0.0, 3: 0.5, 4: 0.0}), (scoring.recent(clicks(spark, asked), clicks(spark, hit)), {2: 0.0, 3: 0.5, 4: 0.0}), (scoring.popular(clicks(spark, asked), clicks(spark, hit)), {2: 1.0, 3: 1.0, 4: 0.0})):
        assert {r["impression_id"]: r["score"] for r in score.collect()} == pytest.approx(want)


def test_covisits(spark):
    rows = [(1, "u", "a", True, at(0)), (1, "u", "b", True, at(0)), (2, "u", "c", True, at(60)), (3, "u", "a", True, at(61)), (4, "u", "z", True, at(5000))]
    got = {(r["item_id"], r["related_item_id"]): r["weight"] for r in scoring.covisit_edges(clicks(spark, rows)).collect()}
    assert ("a", "b") not in {k for k in got if got[k] >= 1 / math.log2(2)}  # never within one impression
    assert got[("a", "c")] == pytest.approx(1 / math.log2(3) + 0.5 / math.log2(2 + 1 / 60))
    assert got[("c", "a")] == pytest.approx(0.5 / math.log2(3) + 1 / math.log2(2 + 1 / 60))
    assert not any("z" in k for k in got)
    with pytest.raises(ValueError):
        scoring.covisit_edges(clicks(spark, rows), 0)


def test_covisit_bands_lose_no_pair(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("uv"), f"i{rng.randrange(12)}", True, at(i * 7)) for i in range(150)]
    got = {(r["item_id"], r["related_item_id"]): r["weight"] for r in scoring.covisit_edges(clicks(spark, rows), 600, 4).collect()}
    want = {}
    for user in "uv":
        mine = [r for r in rows if r[1] == user]
        for p, a in enumerate(mine):
            for b in mine[p + 1 : p + 5]:
                gap = (b[4] - a[4]).total_seconds()
                if a[2] != b[2] and gap <= 600:
                    w = 1 / math.log2(2 + gap / 60)
                    want[(a[2], b[2])] = want.get((a[2], b[2]), 0) + w
                    want[(b[2], a[2])] = want.get((b[2], a[2]), 0) + w / 2
    assert got == pytest.approx(want)


def test_terms(spark):
    got = [r["term"] for r in scoring.tokenize(frame(spark, [(1, "The CAT, and a naïve x2 b!"), (2, None)], "id int, t string"), "id", "t").collect()]
    assert got == ["cat", "na", "ve", "x2"]


# metrics


def scored(spark, rows):
    return frame(spark, rows, "impression_id long, user_id string, item_id string, clicked boolean, score double")


def test_tied_and_one_sided_slates(spark):
    rows = [(1, "u", "a", True, 0.5), (1, "u", "b", False, 0.5), (2, "u", "a", True, 0.1), (3, "u", "a", False, 0.3), (3, "u", "b", True, 0.2), (4, "u", "a", False, 1.0)]
    got = {r["impression_id"]: r for r in measure.slate_metrics(scored(spark, rows), 1).collect()}
    assert (got[1]["auc"], got[2]["auc"], got[3]["auc"], got[4]["auc"]) == (0.5, None, 0.0, None)
    assert got[4]["ndcg"] is None and got[3]["ndcg"] == 0 and got[3]["reciprocal_rank"] == 0.5 and got[1]["flat"] and got[2]["ndcg"] == 1


def test_slate_metrics_by_hand(spark):
    rng = random.Random(7)
    rows = [(s, "u", f"i{k}", rng.random() < 0.3, round(rng.random(), 1)) for s in range(80) for k in range(rng.randint(1, 12))]
    got = {r["impression_id"]: r for r in measure.slate_metrics(scored(spark, rows), 5).collect()}
    for s in range(80):
        mine = [r for r in rows if r[0] == s]
        pos, neg = [r[4] for r in mine if r[3]], [r[4] for r in mine if not r[3]]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert got[s]["auc"] == (pytest.approx(auc) if auc is not None else None)


def test_global_auc(spark):
    rng = random.Random(9)
    rows = [(i, "u", "i", rng.random() < 0.4, round(rng.random(), 2)) for i in range(400)]
    pos, neg = [r[4] for r in rows if r[3]], [r[4] for r in rows if not r[3]]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert measure.global_auc(scored(spark, rows)).first()["auc"] == pytest.approx(want)


def gini(x):
    x = sorted(x)
    return sum((2 * (i + 1) - len(x) - 1) * v for i, v in enumerate(x)) / (len(x) * sum(x))


def test_gini(spark):
    for xs in ([1, 1, 1], [1, 5, 5, 9, 0, 2]):
        df = frame(spark, [(v,) for v in xs], "x long")
        assert measure.gini(df, "x").first()["gini"] == pytest.approx(gini(xs), abs=1e-12)
        assert measure.gini(df, "x", 20).first()["gini"] == pytest.approx(gini(xs + [0] * (20 - len(xs))), abs=1e-12)


def test_diversity(spark):
    vectors = frame(spark, [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "item_id string, vector array<double>")
    rows = frame(spark, [(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "z"), (4, "q")], "impression_id long, item_id string")
    assert {r["impression_id"]: r["diversity"] for r in measure.diversity(rows, vectors).collect()} == {1: pytest.approx(1.0), 2: None, 3: pytest.approx(1.0)}


def test_bands(spark):
    got = [r[0] for r in frame(spark, [(0,), (1,), (2,), (3,), (5,), (501,)], "n int").select(measure.bands(F.col("n"), (0, 2, 5, 500))).collect()]
    assert got == ["0", "1-2", "1-2", "3-5", "3-5", "501+"]


# experiments


@pytest.mark.parametrize(("x", "df", "p"), [(3.841458820694124, 1, 0.05), (10.827566170662733, 1, 0.001), (5.991464547107979, 2, 0.05), (0.0, 3, 1.0), (30.0, 10, 0.0008566412)])
def test_chi_square(x, df, p):
    assert inference.chi_square_tail(x, df) == pytest.approx(p, rel=1e-6)


def test_sample_ratio():
    assert inference.sample_ratio({"a": 5000, "b": 5400}, {"a": 1, "b": 1}).mismatch
    assert not inference.sample_ratio({"a": 5000, "b": 5100}, {"a": 1, "b": 1}).mismatch
    with pytest.raises(ValueError):
        inference.sample_ratio({"a": 1, "b": 1}, {"a": 1, "b": 1})


def test_cuped_reduces_variance_by_r_squared(spark):
    rng = np.random.default_rng(0)
    pre = rng.normal(size=2000)
    post = 2 * pre + rng.normal(size=2000)
    units = frame(spark, [(float(a), float(b)) for a, b in zip(pre, post, strict=True)], "pre double, post double")
    r2 = np.corrcoef(pre, post)[0, 1] ** 2
    row = inference.cuped(units).agg(F.var_samp("adjusted").alias("v"), F.avg("adjusted").alias("m"), F.avg("post").alias("p")).first()
    assert 1 - row["v"] / np.var(post, ddof=1) == pytest.approx(r2) and row["m"] == pytest.approx(row["p"])


def test_off_policy_refusals(spark):
    log = frame(spark, [(True, 0.5, 0.5), (False, 0.5, 1.0), (True, 0.0, 0.5)], "reward boolean, logging_prob double, target_prob double")
    with pytest.raises(Exception, match="isn't positive"):
        inference.off_policy(log).collect()
    row = inference.off_policy(log, drop_invalid=True).first()
    assert row["n"] == 2 and row["invalid"] == 1 and row["snips"] == pytest.approx(1 / 3) and row["ess"] == pytest.approx(9 / 5)
    assert inference.off_policy(log, clip=1.5, drop_invalid=True).first()["clipped_share"] == 0.5


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(5)
    units = frame(spark, [(i, float(v)) for i, v in enumerate(rng.normal(10, 3, 900))], "u long, v double")
    row = inference.interval(inference.bootstrap_means(units, "u", ["v"], 300), F.col("v")).first()
    half = 1.96 * 3 / 30
    assert row["lo"] < 10.2 and row["hi"] > 9.8 and 0.6 * half < (row["hi"] - row["lo"]) / 2 < 1.5 * half


def test_power_is_consistent():
    n = inference.sample_size(0.1, 0.05)
    assert inference.two_proportion_power(0.1, 0.05, n) >= 0.8 > inference.two_proportion_power(0.1, 0.05, n - 1)
    assert inference.detectable_lift(0.1, n) == pytest.approx(0.05, rel=1e-3)


def test_launch_rules():
    fine, bad = inference.sample_ratio({"a": 500, "b": 500}, {"a": 1, "b": 1}), inference.sample_ratio({"a": 900, "b": 500}, {"a": 1, "b": 1})
    up, flat, slow = inference.Metric("ctr", 0.1, 0.05, 0.15), inference.Metric("ctr", 0.0, -0.1, 0.1), inference.Metric("latency", 0.2, 0.1, 0.3, False, 0.05)
    assert [inference.launch(*x)[0] for x in ((bad, up), (fine, up, [slow]), (fine, up), (fine, flat))] == ["invalid", "hold", "launch", "hold"]
    assert inference.launch(fine, flat, least_lift=0.05, target_lift=0.02)[0] == "extend"
    assert inference.gate({"overall": 0.5}, {"overall": 0.52}, {}, ["overall", "cold"]) == ["overall: fell by 0.0200", "cold: not measured"]
    assert inference.gate({"overall": 0.52}, {"overall": 0.52}, {}, ["overall"]) == []


def test_gates_by_cohort(spark):
    rows = [("fell", u, 0.5, 0.4 + u / 1000) for u in range(9)] + [("ok", u, 0.5, 0.5 + (u % 2) / 9) for u in range(8)] + [("small", u, 0.5, 0.498 - u / 10_000) for u in range(9)] + [("none", 1, None, 0.2), ("one", 1, 0.5, 0.499)]
    got = {r["cohort"]: (r["n"], r["verdict"]) for r in inference.gated(frame(spark, rows, "cohort string, user_id long, a double, b double")).collect()}
    assert got == {"fell": (9, "fell"), "ok": (8, "ok"), "small": (9, "significant fall"), "none": (0, "not measured"), "one": (1, "significant fall")}


def test_models_by_their_specs(spark):
    for bad in ("other", "decayed", "popular@3"):
        with pytest.raises(ValueError):
            scoring.named(bad)
    with pytest.raises(ValueError, match="half-life"):
        scoring.named("decayed@-1")(frame(spark, [], "item_id long, ts timestamp"), frame(spark, [], "item_id long, ts timestamp, clicked boolean"))


def test_chi_square_tails():
    known = {(3.841458820694124, 1): 0.05, (5.991464547107979, 2): 0.05, (7.814727903251179, 3): 0.05, (18.307038053275146, 10): 0.05, (24.99579013972863, 15): 0.05, (0.0, 4): 1.0, (1e-9, 9): 1.0, (700.0, 5): 0.0}
    for (x, df), p in known.items():
        assert inference.chi_square_tail(x, df) == pytest.approx(p, abs=1e-12)


def test_short_pools_and_small_catalogues_are_refused(spark):
    requests, catalogue = frame(spark, [(1,), (2,)], "request long"), frame(spark, [(i,) for i in range(4)], "item long")
    pools = lambda *v: frame(spark, list(v), "request long, item long")
    measure.require_pools(requests, pools((1, 0), (1, 1), (2, 2), (2, 3)), catalogue, 2)
    with pytest.raises(ValueError, match="1 requests have fewer than k = 2"):
        measure.require_pools(requests, pools((1, 0), (1, 1), (2, 2), (2, 2)), catalogue, 2)
    with pytest.raises(ValueError, match="2 requests have fewer"):
        measure.require_pools(requests, pools((3, 1)), catalogue, 2)
    with pytest.raises(ValueError, match="catalogue has 4"):
        measure.require_pools(requests, pools((1, 0)), catalogue, 5)


def test_factor_models_refuse_ids_that_are_no_numbers(spark):
    with pytest.raises(ValueError, match="dense_ids"):
        scoring.als_factors(frame(spark, [("u", "i", True)], "user_id string, item_id string, clicked boolean"))


def test_assignment_shares(spark):
    got = spark.range(20000).select(inference.assign(F.col("id"), "e", {"a": 25, "b": 50}).alias("arm")).groupBy("arm").count().collect()
    n = {r["arm"]: r["count"] for r in got}
    assert abs(n["a"] - 5000) < 300 and abs(n["b"] - 10000) < 300 and abs(n[None] - 5000) < 300


def test_constant_predictions_are_one_bin(spark):
    got = inference.reliability(frame(spark, [(0.3, 1), (0.3, 0)], "probability double, label int")).collect()
    assert len(got) == 1 and got[0]["observed"] == 0.5


# retrieval and re-ranking


def test_knn_blocks_lose_nothing(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8))
    items = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], "item long, vector array<double>")
    got = candidates.knn_exact(items.where("item < 5").withColumnRenamed("item", "request"), items, 7, 15).collect()
    for q in range(5):
        want = np.argsort(-(v @ v[q]), kind="stable")[:7].tolist()
        assert [r["item"] for r in sorted((r for r in got if r["request"] == q), key=lambda r: r["rank"])] == want
    near = candidates.knn_ivf(items.where("item < 5").withColumnRenamed("item", "request"), items, 7, cells=4, probes=4)
    exact = candidates.knn_exact(items.where("item < 5").withColumnRenamed("item", "request"), items, 7)
    assert candidates.agreement(exact, near, 7).agg(F.avg("agreement")).first()[0] == 1.0


def test_equal_vectors_tie_by_item(spark):
    items = frame(spark, [(i, [0.1, 0.7, 0.3]) for i in range(40)], "item long, vector array<double>")
    got = candidates.knn_exact(items.where("item = 3").withColumnRenamed("item", "request"), items, 5, 7).orderBy("rank").collect()
    assert [r["item"] for r in got] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(
    ("lists", "quotas", "most", "want"),
    [
        ({"a": [1, 2, 3], "b": [2, 4, 5]}, (2, 2), 4, [1, 2, 4, 5]), ({"a": [1, 0, 0], "b": [2, 3, 4]}, (3, 1), 4, [1, 2, 3, 4]), ({"a": [1, 2, 3], "b": [4]}, (3, 0), 5, [1, 2, 3, 4]),
        ({"a": [7, 7, 8], "b": [8, 9]}, (2, 1), 3, [7, 8, 9]), ({"a": [], "b": [5, 6]}, (2, 1), 2, [5, 6]), ({"a": [1, 2, 3, 4], "b": [9]}, (4, 1), 2, [1, 2]),
    ],
)
def test_blending(spark, lists, quotas, most, want):
    rows = [(1, s, r, i) for s, items in lists.items() for r, i in enumerate(items, 1)]
    got = candidates.blend(frame(spark, rows, "request long, source string, rank int, item long"), tuple(lists), quotas, most)
    assert [r["item"] for r in got.orderBy("position").collect()] == want


def pool(spark, rows):
    return frame(spark, rows, "request long, item long, score double, vector array<double>, category string, blocked boolean")


def test_greedy_slates(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 1, 0.9, x, "a", False), (1, 2, 0.8, x, "a", False), (1, 3, 0.5, y, "b", False), (1, 4, 0.4, y, "b", True)]
    items = lambda **k: [r["item"] for r in candidates.greedy_slates(pool(spark, rows), k.pop("k", 3), **k).orderBy("position").collect()]
    assert items() == [1, 2, 3]
    assert items(relevance=0.5) == [1, 3, 2]
    assert items(cap=1) == [1, 3, 2]  # then the cap yields
    assert items(k=9) == [1, 2, 3]
    blocked = [(*r[:5], True) for r in rows]
    assert [r["item"] for r in candidates.greedy_slates(pool(spark, blocked), 2).orderBy("position").collect()] == [1, 2]
    many = [(q, i, 1.0 / (i + 1), x, "a", False) for q in range(300) for i in range(4)]
    got = candidates.greedy_slates(pool(spark, many), 2, epsilon=0.4, explore=1)
    assert {round(r["propensity"], 6) for r in got.where("position = 1").select("propensity").distinct().collect()} == {round(0.4 / 3, 6), round(0.6 + 0.4 / 3, 6)}
    best = got.where("position = 1 and item = 1").count() / 300
    assert abs(best - (0.6 + 0.4 / 3)) < 0.1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, candidates.greedy_slates(pool(spark, many).repartition(7), 2, epsilon=0.4, explore=1).collect()))


def test_slates_with_missing_scores_and_vectors(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 1, None, x, "a", False), (1, 2, 0.4, x, "a", False), (1, 3, float("nan"), y, "b", False), (1, 4, -5.0, None, "b", False), (1, 5, 0.3, x, "b", False)]
    more = [(2, 7, 0.5, None, "a", False), (2, 8, None, None, "a", False)]  # a pool without any vector
    for relevance, first in ((1.0, [2, 5, 4, 1, 3]), (0.5, [2, 5, 4, 1, 3]), (0.0, [2, 4, 5, 1, 3])):
        got = candidates.greedy_slates(pool(spark, rows + more).coalesce(1), 5, relevance=relevance).orderBy("position")
        assert [r["item"] for r in got.where("request = 1").collect()] == first
        assert [r["item"] for r in got.where("request = 2").collect()] == [7, 8]


def slate_by_hand(pool, k, relevance, cap, epsilon, explore, draws):
    """One request's slate by definition; ``draws`` gives the two numbers of a slot."""
    left = sorted((r for r in pool if not r["blocked"]) if not all(r["blocked"] for r in pool) else pool, key=lambda r: (-r["score"], r["item"]))
    total, chosen, out = min(k, len(left)), [], []
    while len(out) < total:
        full = [r for r in left if sum(c["category"] == r["category"] for c in chosen) >= cap]
        room = [r for r in left if r not in full] or left
        gain = lambda r: relevance * r["score"] - (1 - relevance) * max([0.0, *(float(np.dot(r["vector"], c["vector"])) for c in chosen)])
        best = max(room, key=lambda r: (round(gain(r), 12), -room.index(r)))
        chance, pick = 1.0, best
        if len(out) >= total - explore and epsilon > 0:
            u, v = draws(len(out))
            if u < epsilon:
                pick = room[int(v * len(room))]
            chance = epsilon / len(room) + (1 - epsilon if pick is best else 0)
        out.append((pick["item"], chance))
        chosen.append(pick)
        left = [r for r in left if r is not pick]
    return out


@pytest.mark.parametrize(("relevance", "cap", "epsilon", "explore"), [(1.0, 9, 0.0, 0), (0.6, 2, 0.0, 0), (0.3, 1, 0.5, 3), (0.0, 2, 1.0, 9)])
def test_slates_by_hand(spark, relevance, cap, epsilon, explore, monkeypatch):
    import hashlib

    rng = random.Random(5)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(np.random.default_rng(rng.randrange(10**6)).normal(size=6))
    rows = [(q, i, round(rng.random(), 2), unit(), rng.choice("abc"), rng.random() < (0.3 if q % 5 else 1.1)) for q in range(60) for i in range(1 + q % 11)]
    number = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16) / 2**32
    got = {}
    for r in candidates.greedy_slates(pool(spark, rows), 6, relevance, cap, epsilon, explore, seed=3).orderBy("request", "position").collect():
        got.setdefault(r["request"], []).append((r["item"], r["propensity"]))
    names = ("request", "item", "score", "vector", "category", "blocked")
    for q in range(60):
        mine = [dict(zip(names, r, strict=True)) for r in rows if r[0] == q]
        want = slate_by_hand(mine, 6, relevance, cap, epsilon, explore, lambda slot, q=q: (number(3, q, slot, "explores"), number(3, q, slot, "picks")))
        assert [i for i, _ in got[q]] == [i for i, _ in want] and [p for _, p in got[q]] == pytest.approx([p for _, p in want])


def test_index_reaches_its_recall_with_fewer_probes(spark):
    for size in ("sf0.01", "sf0.1"):
        v = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector")).cache()
        asked = v.where("item % 50 = 0").withColumnRenamed("item", "request")
        centres, placed = candidates.ivf_cells(v, 32, 42)
        probes = candidates.probes_for(asked, v, placed, centres, 10, 0.95)
        assert 0 < probes < 32
        got = candidates.agreement(candidates.knn_exact(asked, v, 10), candidates.knn_ivf(asked, v, 10), 10)
        assert got.agg(F.avg("agreement")).first()[0] >= 0.9


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_quantised_index_reaches_its_recall(spark, size):
    v = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector")).cache()
    asked = v.where("item % 50 = 0").withColumnRenamed("item", "request")
    index = quantised.build(v)
    assert index.codes.count() == v.count() and {len(r["code"]) for r in index.codes.select("code").distinct().collect()} == {16}
    exact = candidates.knn_exact(asked, v, 10)
    got = quantised.search(index, asked, 10)
    assert candidates.agreement(exact, got, 10).agg(F.avg("agreement")).first()[0] >= 0.9
    true = {(r["request"], r["item"]): r["score"] for r in exact.collect()}
    assert all(r["score"] == pytest.approx(true[r["request"], r["item"]], abs=1e-6) for r in got.collect() if (r["request"], r["item"]) in true)


def test_codes_in_lots_and_odd_sizes(spark, monkeypatch):
    monkeypatch.setattr(quantised, "LOT", 40)
    rng = np.random.default_rng(1)
    v = frame(spark, [(i, (lambda x: (x / np.linalg.norm(x)).tolist())(rng.normal(size=8))) for i in range(600)], "item long, vector array<double>")
    asked = v.where("item < 7").withColumnRenamed("item", "request")
    exact = {(r["request"], r["item"]) for r in candidates.knn_exact(asked, v, 5).collect()}
    got = quantised.search(quantised.build(v, parts=2, cells=3), asked, 5, probes=3, rescored=200)
    assert {(r["request"], r["item"]) for r in got.collect()} == exact
    few = v.where("item < 4")
    assert quantised.knn_ivfpq(asked, few, 5).count() == 28 and candidates.knn_ivf(asked, few, 5).count() == 28
    assert candidates.knn_ivf(asked, v.where("item = 3"), 5).count() == 7 and quantised.knn_ivfpq(asked, v.where("false"), 5).count() == 0
    assert candidates.knn_ivf(asked, v.where("item < 2"), 5, cells=32).count() == 14
    with pytest.raises(ValueError, match="divide"):
        quantised.build(v, parts=3)
    assert [candidates.cells_for(n) for n in (1, 100, 1000, 10**6, 10**9)] == [1, 2, 25, 4000, 4096]


def test_large_catalogues_go_through_the_index(spark):
    rng = np.random.default_rng(8)
    v = frame(spark, [(i, (lambda x: (x / np.linalg.norm(x)).tolist())(rng.normal(size=16))) for i in range(900)], "item long, vector array<double>")
    asked = v.where("item % 30 = 0").withColumnRenamed("item", "request")
    exact = candidates.knn_exact(asked, v, 5)
    assert sorted(map(tuple, quantised.knn(asked, v, 5).collect())) == sorted(map(tuple, exact.collect()))
    assert candidates.agreement(exact, quantised.knn(asked, v, 5, exact_below=100), 5).agg(F.avg("agreement")).first()[0] >= 0.9


def test_tiles_hold_little_and_tie_by_item():
    import tracemalloc

    rng = np.random.default_rng(0)
    n = 20_000
    q = pa.table({"request": pa.array(range(n)), "vector": pa.FixedSizeListArray.from_arrays(pa.array(rng.integers(-3, 4, n * 8).astype(float)), 8).cast(pa.list_(pa.float64()))})
    v = pa.table({"item": pa.array(rng.permutation(n)), "vector": q["vector"]})
    tracemalloc.start()
    out = candidates._block_winners(3)(q, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and out.num_rows == 3 * n
    a = candidates.matrix(q["vector"])
    items = np.asarray(v["item"])
    for r in (0, 1234, n - 1):
        s = np.round(a[r] @ a.T, 9)
        assert out.filter(pa.compute.equal(out["request"], r))["item"].to_pylist() == items[np.lexsort((items, -s))][:3].tolist()


def test_caps_in_sql_agree_with_the_loop(spark):
    rng = random.Random(11)
    rows = [(q, i, round(rng.random(), 3), [1.0], rng.choice("abc"), False) for q in range(40) for i in range(9)]
    loop = sorted((r["request"], r["item"]) for r in candidates.greedy_slates(pool(spark, rows), 5, cap=2).collect())
    plan = sorted((r["request"], r["item"]) for r in candidates.capped(pool(spark, rows), 5, 2).collect())
    assert loop == plan


# monitoring


def test_psi(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=4000), rng.normal(1, 1, size=4000)
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    opened = edges.copy()
    opened[0], opened[-1] = -np.inf, np.inf
    e, n = (np.maximum(np.histogram(x, opened)[0] / len(x), 1e-6) for x in (a, b))
    df = [frame(spark, [(float(v),) for v in x], "x double") for x in (a, b)]
    row = monitor.psi(*df, ["x"]).first()
    assert row["psi"] == pytest.approx(((n - e) * np.log(n / e)).sum()) and row["band"] == "SKEW"
    assert monitor.psi(df[0], df[0], ["x"]).first()["psi"] == pytest.approx(0)


def test_psi_of_a_constant_is_zero_or_infinite(spark):
    rows = lambda v: frame(spark, [(v, float(i)) for i in range(50)], "x double, y double")
    steady, moved = ({r["feature"]: (r["psi"], r["band"]) for r in monitor.psi(rows(3.0), rows(v), ["x", "y"]).collect()} for v in (3.0, 4.0))
    assert steady["x"] == (0.0, "OK") and moved["x"] == (float("inf"), "SKEW") and steady["y"][1] == moved["y"][1] == "OK"
    some = rows(3.0).withColumn("x", F.when(F.col("y") > 40, 9.0).otherwise(3.0))
    assert monitor.psi(rows(3.0), some, ["x"]).first()["psi"] == float("inf")


def test_quantiles_by_numpy(spark):
    rng = np.random.default_rng(8)
    points, values = [0, 0.1, 0.333, 0.5, 0.9, 1], {"a": rng.normal(size=501), "b": rng.integers(0, 4, 90).astype(float), "c": np.array([7.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("d", None)]
    got = {r["feature"]: r["values"] for r in ranges.quantiles(frame(spark, rows, "feature string, x double"), points).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k] == pytest.approx(np.quantile(v, points).tolist())


def test_scores_of_a_hot_user_stay_linear(spark):
    """The rows that meet are asks and additions in one union, not labels x earlier clicks."""
    label, item = list(range(400)), lambda i: i % 20
    rows = frame(spark, [(i, 1, item(i), at(i * 60), i % 2 == 0) for i in label], "impression_id long, user_id long, item_id long, ts timestamp, clicked boolean")
    edges = frame(spark, [(a, (a + d) % 20, 1.0 / d) for a in range(20) for d in (1, 2, 3)], "item_id long, related_item_id long, weight double")
    got = {r["impression_id"]: r["score"] for r in scoring.covisit(rows, rows.where("false"), edges).collect()}
    for i in label:
        assert got[i] == pytest.approx(sum(1.0 / d for j in range(0, i, 2) for d in (1, 2, 3) if (item(j) + d) % 20 == item(i)))
    plan = scoring.covisit(rows, rows.where("false"), edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "ts#" not in "".join(line for line in plan.splitlines() if "Join" in line and "<" in line)


def test_histories_meet_two_blocks(spark):
    clicks = frame(spark, [(1, at(10 * i), i) for i in range(137)] + [(1, at(500), 900)], "user_id long, ts timestamp, item_idx int")
    asked = frame(spark, [(k, 1, at(t)) for k, t in enumerate((0, 5, 10, 501, 500, 777, 5000))] + [(99, 2, at(9))], "impression_id long, user_id long, ts timestamp")
    got = {r["impression_id"]: r for r in timeline.clicks_before(asked, clicks, cap=50).collect()}
    every = sorted([(10 * i, i) for i in range(137)] + [(500, 900)])
    for k, t in enumerate((0, 5, 10, 501, 500, 777, 5000)):
        before = [i for s, i in every if s < t]
        assert got[k]["inwindow_idx"] == before[::-1][:50] and got[k]["inwindow_len"] == len(before)
    assert got[99]["inwindow_idx"] == [] and got[99]["inwindow_len"] == 0


def test_ks(spark):
    a, b = [1.0, 2.0, 2.0, 3.0], [2.0, 3.0, 4.0, 5.0, 6.0]
    got = monitor.kolmogorov_smirnov(*(frame(spark, [(v,) for v in x], "x double") for x in (a, b)), "x").first()["ks"]
    assert got == pytest.approx(max(abs(sum(v <= t for v in a) / 4 - sum(v <= t for v in b) / 5) for t in range(8)))


def test_positions_are_dense(spark):
    got = monitor.numbered(spark.range(100).select((F.col("id") * 37 % 101).alias("x")), ["x"]).orderBy("x").collect()
    assert [r["position"] for r in got] == list(range(100))


# streaming


def test_repeats_and_late_rows(spark):
    rows = frame(spark, [(i, at(i * 10), at(i * 10 + (25 if i % 7 == 0 else 0))) for i in range(60)], "event_id long, ts timestamp, ingest_ts timestamp")
    twice = rows.unionByName(rows.where("event_id % 5 = 0"))
    got = streams.drained(streams.dedupe(streams.replay(twice, "ingest_ts", 3)), "append", "t")
    assert sorted(r["event_id"] for r in got.collect()) == list(range(60))


def test_seen_items_expire(spark):
    day = 86400
    rows = [(1, 5, at(0)), (1, 5, at(day)), (1, 6, at(day)), (1, 5, at(9 * day)), (2, 5, at(9 * day))]
    stream = streams.replay(frame(spark, rows, "user_id long, item_id long, ts timestamp"), "ts", 3).withWatermark("ts", "10 seconds")
    got = {(r["user_id"], r["item_id"], r["ts"]): r["seen"] for r in streams.drained(streams.unseen(stream), "append", "t").collect()}
    assert got == {(1, 5, at(0)): False, (1, 5, at(day)): True, (1, 6, at(day)): False, (1, 5, at(9 * day)): False, (2, 5, at(9 * day)): False}


def test_a_late_showing_is_not_seen_and_makes_a_later_one_seen(spark):
    day = 86400
    rows = [(1, 5, at(1000), 1), (1, 5, at(990), 2), (1, 5, at(1001), 3), (1, 5, at(995), 4), (2, 5, at(8 * day), 5), (1, 5, at(8 * day), 6), (1, 5, at(7 * day + 1001), 7)]
    stream = streams.replay(frame(spark, rows, "user_id long, item_id long, ts timestamp, n int").withColumn("arrives", F.timestamp_seconds("n")), "arrives", 7)
    told = streams.drained(streams.unseen(stream.withWatermark("ts", "1 day"), late_seconds=86_400), "append", "t")
    got = {(r["user_id"], r["ts"]): r["seen"] for r in told.groupBy("user_id", "ts").agg(F.max_by("seen", "version").alias("seen")).collect()}
    assert got == {(1, at(990)): False, (1, at(995)): True, (1, at(1000)): True, (1, at(1001)): True, (1, at(7 * day + 1001)): True, (1, at(8 * day)): True, (2, at(8 * day)): False}


def test_the_state_of_the_seen_list_shrinks(spark):
    """Items shown once long ago leave the state when their time to live and the lateness are over."""
    rows = [(1, i, at(i), 1) for i in range(50)] + [(1, 99, at(4000), 2), (1, 98, at(8000), 3), (1, 97, at(8001), 4), (1, 96, at(8002), 5)]
    stream = streams.replay(frame(spark, rows, "user_id long, item_id long, ts timestamp, n int").withColumn("arrives", F.timestamp_seconds("n")), "arrives", 5)
    query = streams.unseen(stream.withWatermark("ts", "10 seconds"), 1000, 60).writeStream.format("noop").outputMode("append").option("checkpointLocation", streams.new_path(spark, "ttl")).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) >= 50 and sizes[-1] < 12, sizes


def test_dropped_rows_are_accounted_for(spark):
    rows = [(i, at(i * 10), at(i * 10)) for i in range(60)] + [(100 + i, at(i), at(590)) for i in range(7)]
    stream = streams.dedupe(streams.replay(frame(spark, rows, "event_id long, ts timestamp, ingest_ts timestamp"), "ingest_ts", 4))
    kept, told = streams.accounted(stream, "t")
    assert told.first().asDict() == {"arrived": 67, "kept": 60, "dropped": 7} and kept.count() == 60
    nothing = streams.dedupe(streams.replay(frame(spark, [], "event_id long, ts timestamp, ingest_ts timestamp"), "ingest_ts", 2))
    assert streams.accounted(nothing, "t")[1].first().asDict() == {"arrived": 0, "kept": 0, "dropped": 0}


# stores


def test_a_dictionary_only_grows(spark, tmp_path):
    path, rows = f"file://{tmp_path}/map", lambda *v: frame(spark, [(x,) for x in v], "u string")
    assert dictionary.create(rows("b", "a", None, "a"), "u", path) == 2
    with pytest.raises(ValueError, match="append"):
        dictionary.create(rows("z"), "u", path)
    assert dictionary.append(rows("a", "0", "c"), "u", path) == 2 and dictionary.append(rows("b", None), "u", path) == 0
    assert dictionary.append(rows("d"), "u", path) == 1 and dictionary.versions(spark, path) == 4
    got = {r["value"]: r["idx"] for r in dictionary.read(spark, path).collect()}
    assert got == {"a": 1, "b": 2, "0": 3, "c": 4, "d": 5} and dictionary.read(spark, path, 0).count() == 2
    assert [r["value"] for r in dictionary.uncovered(rows("a", "q", None), "u", path).collect()] == ["q"]
    pairs = lambda *v: frame(spark, list(v), "value string, idx long")
    held = dictionary.read(spark, path, 0)
    dictionary.refuse_moves(held, pairs(("a", 1), ("b", 2), ("n", 3)))
    for bad in ((("a", 2), ("b", 1)), (("a", 1),), (("a", 1), ("b", 2), ("n", 2))):
        with pytest.raises(ValueError, match="would"):
            dictionary.refuse_moves(held, pairs(*bad))


def test_views_merge_expire_and_compact(spark, tmp_path):
    view = online.View(f"file://{tmp_path}/view", ("k",), ("x",), 2, 4)
    rows = lambda *v: frame(spark, list(v), "k string, feature_ts timestamp, created_ts timestamp, x int")
    with pytest.raises(ValueError, match="nothing"):
        online.read(spark, view)
    hour = 3600
    online.push(view, rows(("a", at(0), at(1), 1), ("a", at(hour), at(1), 2), ("b", at(0), at(1), 3), (None, at(0), at(0), 9), ("c", None, at(0), 9)))
    online.push(view, rows(("a", at(hour), at(0), 7), ("b", at(5 * hour), at(9), 4)))  # created before, and later in time
    told = lambda: {r["k"]: r["x"] for r in online.read(spark, view).collect()}
    assert told() == {"a": 2, "b": 4}
    online.compact(spark, view)
    online.push(view, rows().where("false"))
    online.push(view, rows(("a", at(hour), at(2), 8)))
    assert told() == {"a": 8, "b": 4} and online._parts(spark, view) == [2, 3, 4]
    asked = frame(spark, [("a",), ("b",), ("z",)], "k string")
    got = {r["k"]: (r["x"], r["found"]) for r in online.lookup(spark, view, asked, F.lit(at(4 * hour))).collect()}
    assert got == {"a": (None, False), "b": (4, True), "z": (None, False)}


def test_ranges_materialised_twice_equal_once(spark, tmp_path):
    rng = random.Random(2)
    series = frame(spark, [(rng.choice("abc"), at(rng.randrange(100) * 60 + i), i) for i in range(200)], "k string, feature_ts timestamp, x int")
    made = []
    for name, spans in (("one", [(0, 9999)]), ("two", [(3000, 9999), (0, 4000), (0, 4000), (3000, 9999)])):
        view = online.View(f"file://{tmp_path}/{name}", ("k",), ("x",), 2)
        for a, b in spans:
            online.materialise(view, series, F.lit(at(a)), F.lit(at(b)), F.lit(at(10**6)))
        made.append(sorted(map(tuple, online.read(spark, view).select("k", "x", "feature_ts").collect())))
    assert made[0] == made[1] and len(made[0]) == 3


def test_dumps_come_back_by_row(spark, tmp_path):
    rows = [(i * 3, [float(i), i / 7]) for i in range(25)]
    path = f"file://{tmp_path}/dump"
    dump.write(frame(spark, rows, "item long, vector array<double>").repartition(3), path, block_rows=7)
    told = dump.manifest(spark, path).orderBy("block").collect()
    assert [(r["first"], r["n"], r["offset"]) for r in told] == [(0, 7, 0), (7, 7, 56), (14, 7, 112), (21, 4, 168)]
    got = dump.read_rows(spark, path, frame(spark, [(0,), (8,), (24,), (25,), (99,)], "position long")).orderBy("position").collect()
    assert [(r["position"], r["id"], r["vector"]) for r in got] == [(p, p * 3, [float(p), float(np.float32(p / 7))]) for p in (0, 8, 24)]
    with pytest.raises(Exception, match="missing"):
        dump.write(frame(spark, [(1, [None, 1.0])], "item long, vector array<double>"), f"{path}2")


def test_sketches_by_day_merge_to_the_edges(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(at(int(d) * 86400), float(x), float(x) ** 3) for d, x in zip(rng.integers(0, 9, 6000), rng.normal(size=6000), strict=True)], "ts timestamp, x double, y double").cache()
    daily = monitor.daily_sketches(rows, ["x", "y"]).cache()
    first, last = (str(at(d * 86400).date()) for d in (1, 5))
    some = rows.where(F.to_date("ts").between(F.lit(first), F.lit(last)))
    values = {c: np.sort(np.array([r[c] for r in some.select(c).collect()])) for c in "xy"}
    for r in monitor.sketch_edges(monitor.merged_sketches(daily, first, last)).collect():
        ranks = np.searchsorted(values[r["feature"]], r["edges"]) / len(values[r["feature"]])
        assert np.abs(ranks - np.arange(11) / 10).max() < 0.01
    rest = rows.where(F.to_date("ts") > F.lit(last))
    want = {r["feature"]: r["psi"] for r in monitor.psi(some, rest.withColumn("x", F.col("x") + 0.5), ["x", "y"]).collect()}
    moved = monitor.daily_sketches(rest.withColumn("x", F.col("x") + 0.5), ["x", "y"])
    got = {r["feature"]: r["psi"] for r in monitor.sketch_psi(monitor.merged_sketches(daily, first, last), monitor.merged_sketches(moved, "2000-01-01", "2099-01-01")).collect()}
    assert all(abs(got[f] - want[f]) < 0.02 for f in "xy") and want["x"] > 0.1


def test_replay_blocks_what_was_served(spark):
    day = 86400
    rows = [(u, r, at(t), i, s) for u, r, t in ((1, 10, 0), (1, 11, 60), (1, 12, 120), (1, 13, 30 * day), (2, 20, 5)) for i, s in ((1, 0.9), (2, 0.8), (3, 0.7), (4, None), (5, float("nan")))]
    pools = frame(spark, rows, "user_id long, request long, ts timestamp, item long, score double").repartition(3)

    def told(**k):
        got = {}
        for r in candidates.replay_unseen(pools, 2, **k).orderBy("request", "position").collect():
            got.setdefault(r["request"], []).append(r["item"])
        return got

    assert told() == {10: [1, 2], 11: [3, 4], 12: [5], 13: [1, 2], 20: [1, 2]}
    assert told(ttl_seconds=30) == {q: [1, 2] for q in (10, 11, 12, 13, 20)}
    assert told(ttl_seconds=7 * day)[13] == [1, 2] and told(ttl_seconds=90)[12] == [5]


def test_log_q_by_the_recurrence(spark):
    rng = random.Random(3)
    rows = [(s, rng.randrange(6)) for s in range(60) for _ in range(rng.randint(1, 9))]
    for half_life in (2.0, 15.0, 400.0):
        seen, want = np.zeros(7), {}
        for s in range(60):
            own = [i for t, i in rows if t == s]
            for i in set(own):
                want[s, i] = math.log((2.0 + seen[i]) / (2.0 * 7 + seen.sum()))
            seen *= 0.5 ** (len(own) / half_life)
            for i in own:
                seen[i] += 1
        got = {(r["step"], r["item"]): r["log_q"] for r in monitor.log_q(frame(spark, rows, "step long, item long"), "item", "step", half_life, 7, 2.0).collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


# functions


def test_functions(spark):
    columns.register_sql_functions(spark)
    assert spark.sql("SELECT cosine(array(1D, 0D), array(3D, 4D)) AS c, cosine(array(0D), array(1D)) AS n").first() == (pytest.approx(0.6), None)
    assert spark.sql("SELECT smoothed_ctr(1D, 10D, 0.1D, 20D) AS x, freshness(24D, 24D) AS y").first().asDict() == {"x": pytest.approx(0.1), "y": 0.5}
    row = spark.range(1).select(columns.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(2.0))).alias("c"), columns.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0))).alias("z")).first()
    assert row["c"] == pytest.approx(math.sqrt(0.5)) and row["z"] is None


def test_parameters_are_checked(spark):
    for call in (lambda: columns.half_life_weight(F.lit(1.0), 0), lambda: columns.shrunk_rate(F.lit(1), F.lit(1), F.lit(0.1), 0), lambda: transform.slate_negatives(None, 0), lambda: candidates.freshness(F.lit(1), 0), lambda: scoring.strongest(None, 0), lambda: candidates.bloom_size(F.lit(1), 2.0)):
        with pytest.raises(ValueError):
            call()


def test_contracts_count_violations(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", None), (2, None, 9)], "k int, v string, parent int")
    parents = spark.createDataFrame([(5,)], "id int")
    told = contracts.union(
        contracts.rows_where(rows, {"null_v": F.col("v").isNull(), "odd_v": ~F.col("v").isin("a")}),
        contracts.totals(rows, {"few": F.count(F.lit(1)) < 3, "many": F.count(F.lit(1)) >= 3}),
        contracts.duplicate_keys(rows, "twice", ["k"]),
        contracts.orphans(rows, "orphan", "parent", parents, "id"),
    )
    assert {r.contract: r.violations for r in told.collect()} == {"null_v": 1, "odd_v": 1, "few": 0, "many": 1, "twice": 1, "orphan": 1}
    none = rows.where("k > 9")
    assert {r.violations for r in contracts.rows_where(none, {"null_v": F.col("v").isNull()}).collect()} == {0}
    assert contracts.duplicate_keys(none, "twice", ["k"]).first().violations == 0


def test_model_table_refuses_two_splits(spark):
    cards = spark.createDataFrame([("a", "overall", "test", 3, 0.5), ("b", "overall", "test", 3, 0.6)], "model string, cohort string, split string, k int, gauc double")
    assert {r.model: r.overall for r in measure.model_table(cards, "gauc", ["overall", "warm_user"]).collect()} == {"a": 0.5, "b": 0.6}
    for other in (cards.withColumn("split", F.when(F.col("model") == "a", "val").otherwise("test")), cards.withColumn("k", F.when(F.col("model") == "a", 5).otherwise(3))):
        with pytest.raises(Exception, match="more than one split or k"):
            measure.model_table(other, "gauc", ["overall"]).collect()


def test_recent_items_end_with_their_time_to_live(spark):
    day = 86_400
    rows = [(1, 10, "a", True, at(0)), (2, 20, "a", True, at(day)), (2, 21, "b", True, at(2 * day)), (2, 22, "b", True, at(3 * day)), (1, 11, "b", True, at(4 * day)), (2, 23, "b", True, at(4 * day))]
    clicks = frame(spark, rows, "user_id long, item_id long, category string, clicked boolean, ts timestamp")
    want = {None: [11, 10], 10 * day: [11, 10], day // 2: [11]}
    for ttl, items in want.items():
        stream = streams.replay(clicks, "ts", chunks=len(rows))
        stream = stream if ttl is None else stream.withWatermark("ts", streams.LATENESS)
        told = streams.drained(streams.recent_items(stream, ttl_seconds=ttl), "update", "ttl", ["user_id"], "version").collect()
        found = {r.user_id: r.last_items for r in told}
        assert found == {1: items, 2: [23, 22, 21, 20]}, ttl
    with pytest.raises(ValueError, match="ttl_seconds"):
        streams.recent_items(clicks, ttl_seconds=0)
