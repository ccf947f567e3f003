import importlib.util
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline isn't there", allow_module_level=True)

import corpus_pipeline
from larkspur.llm import bpe, mix, rules
from tests.llm.test_simhash import grouped, plain
from tests.llm.test_text_ops import counts

AT = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert len(corpus_pipeline.STAGES) == 5
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "apply_quality_rules", "drop_near_duplicates", "mix_sources", "encode_tokens"]


def test_each_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    stage = [f for _, f in corpus_pipeline.STAGES]
    one = stage[0](spark, docs, AT).cache()
    assert one.columns == docs.columns
    lost = docs.join(one, "doc_id", "left_anti").collect()
    assert all(len(r["text"]) < 40 or not any(map(str.isalpha, r["text"])) for r in lost)

    two = stage[1](spark, one, AT).cache()
    kept = {r["doc_id"] for r in two.collect()}
    for r in one.collect():
        n, chars, symbols, _, repeat = counts(r["text"])
        if n < 50 or 100 * repeat > 50 * n or symbols > 0.1 * n or not 2 <= chars / n <= 16:
            assert r["doc_id"] not in kept

    three = stage[2](spark, two, AT).cache()
    want = grouped([(r["doc_id"], plain(r["text"])) for r in two.collect()])
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(set(want.values()))

    four = stage[3](spark, three, AT).cache()
    per = Counter(r["source"] for r in three.collect())
    total, roots = sum(per.values()), sum(math.sqrt(n) for n in per.values())
    expected = Counter()
    for r in three.select("doc_id", "source", mix.hashed_uniform(F.lit("42"), F.col("doc_id").cast("string")).alias("u")).collect():
        rate = math.sqrt(per[r["source"]]) / roots * total / per[r["source"]]
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= r["u"]:
            k += 1
            p *= rate / k
            c += p
        expected[r["doc_id"]] = k
    assert Counter(r["doc_id"] for r in four.collect()) == +expected and four.columns == docs.columns

    library = bpe.loaded(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    five = stage[4](spark, four, AT).collect()
    assert len(five) == four.count()
    for r in five:
        assert library.decode(np.array(r["ids"], "<u4").tobytes()).decode() == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])


def test_pipeline_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        out = docs
        for _, f in corpus_pipeline.STAGES:
            out = f(spark, out, AT)
        assert out.count() == 0
    assert rules.base_failed() is not None


def test_columns_of_the_stages_come_out_as_they_were(spark):
    text = " ".join(f"the cat of {w} and a dog {i}" for i, w in enumerate("house garden river mountain bridge window table".split()))
    own = ["kept", "score", "Lang_Pred", "n_words", "copy_no", "__t", "a.b", "a`b"]
    docs = spark.createDataFrame([(i, text + f" {i}", "en", "s") for i in range(30)], "doc_id long, text string, lang string, source string")
    out = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in own])
    columns = out.columns
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, out, AT)
        assert out.columns == columns and all(r[c] == f"mine {c}" for r in out.collect() for c in own)
    corpus_pipeline.STAGES[-1][1](spark, out, AT).collect()
