"""Parts of the corpus operators written out a second time, over plain Python values and every row."""

import math

import duckdb
import numpy as np
import pytest

from larkspur.llm import lang_id, quality, queries, rules
from larkspur.llm.common import utf8
from tests.llm.test_queries import AT, fold, spark_free, told


@pytest.fixture(scope="module")
def rows():
    return duckdb.connect().execute(f"SELECT doc_id, coalesce(text, ''), lang, text IS NULL FROM '{AT}/documents.parquet'").fetchall()


def buckets(text):
    """Buckets of all n-grams of 3 and 4 bytes of a text."""
    raw = text.encode()
    c = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in raw]
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E:
            c[i] += 0x20
    out = []
    factors = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
    for n in (3, 4):
        for i in range(len(c) - n + 1):
            if c[i] or c[i + n - 1]:
                h = sum(x * f for x, f in zip(c[i : i + n], factors, strict=False)) % 2**32
                h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                out.append(h >> 16 | 1)
    return out


def test_op1_of_every_row(spark, rows):
    grams = {i: buckets(t) for i, t, *_ in rows}
    share = {}
    for i, _, lang, missing in rows:
        if fold(i, 3) != 1 and lang is not None and not missing:
            np.add.at(share.setdefault(lang, np.zeros(1 << 16)), grams[i], 1)
    langs = sorted(share)
    assert len(langs) == 4
    for k in langs:
        share[k] = (share[k] + 0.5 / 65536) / (share[k].sum() + 0.5)
    got = told(spark, "op1_language_id")
    splits = [[1 if m >> j & 1 == 0 else -1 for j in range(3)] for m in range(1, 8)]  # every split of four in two, once
    bits = []
    for split in splits:
        signs = [1, *split]
        ones, rest = (np.mean([share[k] for k, s in zip(langs, signs, strict=True) if s == side], 0) for side in (1, -1))
        w = np.clip(np.log((ones + 1e-6) / (rest + 1e-6)), -6, 6)
        w[0] = 0
        own = [float(w @ share[k]) for k in langs]
        low, high = max(o for o, s in zip(own, signs, strict=True) if s < 0), min(o for o, s in zip(own, signs, strict=True) if s > 0)
        middle = (low + high) / 2 if high > low else sum(own) / 4
        w[1:] -= middle
        trust = max(min(float(w @ share[k]) * s for k, s in zip(langs, signs, strict=True)), 0.05)
        bits.append((signs, w, trust))
    whole = sum(t for *_, t in bits) / len(bits)
    for i, t, *_ in rows:
        r = got[i]
        if not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        loss = [0.0] * 4
        for signs, w, trust in bits:
            margin = sum(float(w[g]) for g in grams[i]) / max(len(grams[i]), 1)
            for k in range(4):
                loss[k] += trust / whole * math.log1p(math.exp(-8.0 * margin * signs[k]))
        best = loss.index(min(loss))
        assert r["lang_pred"] == langs[best]
        assert r["score"] == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss), abs=1e-3)
    held = [(i, lang) for i, t, lang, _ in rows if fold(i, 3) == 1 and lang and len(t) > 100]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert lang_id.codewords(4).shape == (4, 7)


def test_op8_statistics_by_hand(rows):
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&<>@^~_=+\\/{}[]", "|", "!?", ".", ",;:", "\"'()-", " \t\x0b\x0c\r"]
    for _, t, *_ in rows:
        raw = t.encode()
        n = [sum(raw.count(c.encode()) for c in k) for k in kinds]
        high = sum(b >= 0xC0 for b in raw)
        w = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        per = max(len(w), 1)
        want = [min(x / per, 20) for x in (*n, high)]
        want += [math.log1p(len(w)), min((len(raw) - n[9] - raw.count(b"\n")) / per, 40), math.log1p(len(w) / max(len(lines), 1)), len(set(w)) / per**0.9, (len(lines) - len(set(lines))) / max(len(lines), 1)]
        want += [n[0] / max(n[0] + n[1] + high, 1), min((n[3] + n[4] + n[5]) / per, 1), float(not w)]
        assert quality.statistics(*utf8(spark_free(t)))[0].tolist() == pytest.approx(want)


def test_pipeline_stages_one_and_two_keep_what_they_should(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    one = pipeline.STAGES[0][1](spark, docs, AT).cache()
    told_rows = {r["doc_id"]: r for r in queries.op1_language_id(spark, AT).collect()}
    assert {r["doc_id"] for r in one.collect()} == {i for i, r in told_rows.items() if r["lang_pred"] != "und" and not r["ambiguous"]}
    assert all(r["lang_pred"] == r["lang"] for r in one.join(queries.op1_language_id(spark, AT).select("doc_id", "lang_pred"), "doc_id").where("lang is not null and length(text) > 100").collect())
    two = {r["doc_id"] for r in pipeline.STAGES[1][1](spark, one, AT).collect()}
    con = duckdb.connect()
    con.register("documents", one.toPandas())
    assert two == {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({queries.ORACLE_SQL['op4_quality_rules']})").fetchall() if kept}
    assert 0 < len(two) < one.count() and rules.RULES
