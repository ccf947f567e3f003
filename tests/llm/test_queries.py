"""The registered queries themselves: their SQL, brute force over their columns, and names of any kind."""

import base64
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, chat, lang_id, media, mix, quality, queries, rules, simhash, token_store, warc
from larkspur.llm.common import new_path, utf8
from tests.llm.test_simhash import grouped, plain

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def told(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, AT).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(name, spark, duck):
    df = queries.QUERIES[name](spark, AT)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    line = lambda r, n: tuple(map(repr, (r[c] for c in sorted(n))))
    assert sorted(line(r.asDict(), df.columns) for r in df.collect()) == sorted(line(dict(zip(names, r, strict=True)), names) for r in found.fetchall())


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1_by_brute_force(spark, duck):
    """Margins gram by gram, losses bit by bit, from the counts of the learning texts; nothing of the held-out rows is read."""
    rows = duck.execute("SELECT doc_id, coalesce(text, ''), lang FROM documents").fetchall()
    got = told(spark, "op1_language_id")
    assert len(got) == len(rows) and all(r["held_out"] == (fold(i, 3) == 1) for i, r in got.items())
    gram = lambda t: np.concatenate(lang_id.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))
    counts = {}
    for i, t, lang in rows:
        if fold(i, 3) != 1 and lang is not None:
            counts.setdefault(lang, np.zeros(lang_id.BUCKETS, np.int64))
            np.add.at(counts[lang], gram(t), 1)
    model = lang_id.fit(counts)
    for i, t, _ in rows[:60]:
        g = gram(t)
        g = g[g > 0].tolist()
        margin = [sum(float(w[x]) for x in g) / max(len(g), 1) for w in model.weights]
        loss = [sum(a * math.log1p(math.exp(-lang_id.SHARPNESS * m * int(c))) for a, m, c in zip(model.trust, margin, code, strict=True)) for code in model.code]
        want = loss.index(min(loss))
        p = 1 / sum(math.exp(loss[want] - x) for x in loss)
        if any(map(str.isalpha, t)):
            assert got[i]["lang_pred"] == model.langs[want] and got[i]["score"] == pytest.approx(p, abs=1e-4)
        else:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)


def test_many_languages():
    rng = np.random.default_rng(2)
    counts = {f"l{k:02d}": np.concatenate(([0], rng.gamma(0.05, 1000, lang_id.BUCKETS - 1).astype(np.int64))) for k in range(12)}
    model = lang_id.fit(counts)
    share = np.stack([counts[x] / counts[x].sum() for x in model.langs])
    best, score, close = model.decode(share @ model.weights.T)
    assert best.tolist() == list(range(12)) and not close.any() and (score > 0.9).all()


def test_op2_by_the_library(spark, texts):
    library = Tokenizer.from_file(bpe.default_path())
    got = told(spark, "op2_bpe")
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_op3_has_the_planted_conversation(spark):
    r = queries.op3_chat_format(spark, AT).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_op5_digests(spark, duck):
    pages = dict(duck.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall())
    for r in queries.op5_warc(spark, AT).collect():
        body = pages[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())


def test_op7_by_brute_force(spark, texts):
    fps = [(i, plain(t)) for i, t in texts.items()]
    want = grouped(fps)
    got = told(spark, "op7_simhash")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", want[i]) for i, f in fps}


def test_op8_by_brute_force(spark, duck, texts):
    """The scorer made again from the same rows, with the risk and its gradient written out, must score alike."""
    labels = duck.execute("SELECT doc_id, quality FROM labels").fetchall()
    got = told(spark, "op8_quality_pu")
    assert set(got) == set(texts) and all(r["held_out"] == (fold(i, 4) == 2) and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    stats = {i: quality.statistics(*utf8(spark_free(t)))[0] for i, t in texts.items()}
    good = np.array([stats[i] for i in sorted(i for i, q in labels if q == 1 and fold(i, 4) != 2 and i in stats)])
    web = np.array([stats[i] for i in sorted(texts) if fold(i, 4) != 2])
    scorer = quality.fit(good, web, quality.estimated_prior(good, web))
    for i, r in got.items():
        assert r["score"] == pytest.approx(float(scorer.score(stats[i][None])[0]), abs=1e-6)
    # The risk and its gradient by definition, at the minimum and away from it.
    z = lambda x: np.append(((x - scorer.mean) / scorer.scale).clip(-8, 8), 1.0)
    p, u, w = [z(x) for x in good], [z(x) for x in web], np.append(scorer.weights, scorer.bias)

    def total(w, prior):
        loss = lambda m: math.log1p(math.exp(-m))
        positive = prior * sum(loss(x @ w) for x in p) / len(p)
        negative = sum(loss(-(x @ w)) for x in u) / len(u) - prior * sum(loss(-(x @ w)) for x in p) / len(p)
        return positive, negative

    assert quality.risk(np.array(p) @ w, np.array(u) @ w, scorer.prior) == pytest.approx(total(w, scorer.prior))
    zero = np.zeros_like(w)
    start = np.append(np.zeros(len(w) - 1), math.log(scorer.prior / (1 - scorer.prior)))
    objective = lambda w: sum(max(0, x) if k else x for k, x in enumerate(total(w, scorer.prior)))
    assert objective(w) < objective(start) <= objective(zero) + 1e-9


def spark_free(text):
    import pyarrow as pa

    return pa.array([text], pa.string())


def test_prior_from_positives_and_unlabelled_rows_alone():
    rng = np.random.default_rng(6)
    d = len(quality.FEATURES)
    for planted in (0.3, 0.6, 0.9):
        good, web = rng.normal(0.8, 1, (3000, d)), rng.normal(0.8, 1, (6000, d))
        web[int(6000 * planted) :] -= 1.6
        assert abs(quality.estimated_prior(good, web) - planted) < 0.05
    same = rng.normal(0, 1, (500, d))
    assert 0.8 < quality.estimated_prior(same, rng.normal(0, 1, (500, d))) < 1
    assert quality.estimated_prior(same[:2], same) == 0.5


def test_op9_by_brute_force(spark, texts):
    got = told(spark, "op9_gif_media")
    assert set(got) == set(texts)
    for i, t in texts.items():
        body = t.encode()
        whole = body + bytes(-len(body) % 64 or (0 if body else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        stored = media.gif_of(whole)
        assert (r["media_bytes"], r["media_sha256"], r["n_frames"]) == (len(stored), hashlib.sha256(stored).hexdigest(), len(r["frames"]))
        share = [sum(v >> 4 == b for v in whole) / len(whole) for b in range(16)]
        assert r["feature"] == f"{sum(whole) / len(whole):.3f}:{bytes(round(255 * x) for x in share).hex()}"


def test_op10_by_the_library(spark, texts):
    library, at = Tokenizer.from_file(token_store.default_path()), 0
    got = told(spark, "op10_token_store")
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


OWN = ["__t", "__w", "__n", "__u", "__in", "__text", "__stop", "__source", "__cdf", "__row", "__c", "__b", "a.b", "a`b", "key", "frames", "turns", "said", "data", "kept", "margins", "copy_no"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one two three four", "en", "s"), (2, "one two three four", "en", "s"), (3, None, None, None), (4, "the cat and the dog are in the house", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in OWN])


def same(df, made, n):
    rows = df.collect()
    assert len(rows) == n
    for r in rows:
        for c in OWN:
            if c not in made:
                assert r[c] == f"mine {c}"


def test_names_of_any_kind(spark, clashing):
    same(bpe.round_trip(clashing, with_ids=True), (), 4)
    same(bpe.decode(bpe.encode(clashing)), (), 4)
    model = lang_id.learn(clashing, F.lit(True))
    same(lang_id.identify(clashing, model), lang_id.MADE, 4)
    same(rules.apply_rules(clashing), rules.MADE, 4)
    same(mix.replicate(clashing, weights={"s": 1.0}, rows=40), mix.MADE, mix.replicate(clashing, weights={"s": 1.0}, rows=40).count())
    same(simhash.keep_one(clashing), (), 3)
    assert simhash.near_duplicates(clashing).count() == 4
    scorer = quality.learn(clashing, clashing.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    same(quality.score(clashing, scorer), (), 4)
    assert media.media_columns(clashing).count() == 4
    folder = new_path(spark, "t")
    token_store.write(clashing, folder)
    assert token_store.read_documents(spark, folder).count() == 4
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[F.col(f"`{c.replace('`', '``')}`") for c in OWN])
    folder = new_path(spark, "w")
    warc.write(pages, folder)
    assert warc.read(spark, folder).count() == 4
    turns = clashing.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), *[F.col(f"`{c.replace('`', '``')}`") for c in ["text", *OWN]])
    assert chat.read_back(chat.format_chats(turns)).count() == 4
