import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, chat, lang_id, mix, quality, rules, token_store
from larkspur.llm.common import new_path

CHARACTERS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'.,!<|endoftext|>\x1c\x85\xa0")), max_size=40)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(token_store.default_path())


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(CHARACTERS, CHARACTERS.map(lambda x: x + "<|endoftext|>" + x)))
def test_bpe_as_the_library(text):
    own, library = bpe.loaded(bpe.default_path()), Tokenizer.from_file(bpe.default_path()) if not hasattr(test_bpe_as_the_library, "t") else test_bpe_as_the_library.t
    test_bpe_as_the_library.t = library
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_decodes_parts_of_characters(byte_library):
    own = bpe.loaded(bpe.default_path())
    ids = np.frombuffer(own.encode("\U0001f600中"), "<u4")
    for n in range(len(ids)):
        assert own.decode(ids[:n].astype("<u4").tobytes()).decode() == byte_library.decode(ids[:n].tolist(), skip_special_tokens=False)


def test_bpe_long_piece(byte_library):
    text = "ab" * 20_000
    assert np.frombuffer(bpe.loaded(bpe.default_path()).encode(text), "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_bpe_odd_rows(odd, none, byte_library):
    rows = bpe.round_trip(odd.withColumn("n_tokens", F.lit("mine")), with_ids=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = r["text"] or ""
        ids = byte_library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(none).count() == 0
    back = bpe.decode(bpe.encode(odd)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(CHARACTERS, st.sampled_from(["<|ENDOFTEXT|>x", "It's!", "Été.", "X×."])), max_size=4))
def test_words_as_the_library(texts):
    library = token_store.loaded(token_store.default_path())
    ids, ends = library.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == library.tokenizer.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts(byte_library):
    texts = [" Hello  World", None, "", "a\nB"]
    ids, ends = token_store.WordEncoder(bpe.default_path()).encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == byte_library.encode(t or "", add_special_tokens=False).ids


def test_tables_of_words_and_pieces_are_bounded(monkeypatch, word_library, byte_library):
    monkeypatch.setattr(token_store, "CACHE_BYTES", 2000)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    texts = [f"word{i} other{i * 7} " + "x" * i for i in range(90)]
    words, pieces = token_store.WordEncoder(token_store.default_path()), bpe.ByteBPE(bpe.default_path())
    for t in texts:
        ids, _ = words.encode(pa.array([t], pa.string()))
        assert ids.tolist() == word_library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(pieces.encode(t), "<u4").tolist() == byte_library.encode(t, add_special_tokens=False).ids
        assert len(words.known) < 12 and len(pieces._pieces) < 12 and all(len(w) <= 64 for w in words.known)


@settings(max_examples=60, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=700), min_size=1, max_size=5))
def test_codes_are_addressable(docs):
    parts = [np.array(d, "<u4").tobytes() for d in docs]
    s = token_store.Segment(token_store.pack(list(range(len(docs))), parts))
    flat = [x for d in docs for x in d]
    assert s.ids().tolist() == flat
    for i in {0, len(flat) // 2, len(flat) - 1} & set(range(len(flat))):
        assert s.access(i) == flat[i]
    with pytest.raises(IndexError):
        s.access(len(flat))


def test_token_store_odd_rows(spark, odd, none, word_library):
    folder = new_path(spark, "t")
    token_store.write(odd, folder)
    rows = sorted(token_store.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    docs = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, flat = 0, []
    for r, (doc_id, text) in zip(rows, docs, strict=True):
        ids = [*word_library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        flat += ids
    asked = spark.createDataFrame([(p,) for p in (0, 5, len(flat) // 2, len(flat) - 1, len(flat), -1)], "position long")
    got = {r["position"]: r["id"] for r in token_store.lookup(spark, folder, asked).collect()}
    assert got == {p: flat[p] for p in (0, 5, len(flat) // 2, len(flat) - 1)}
    empty = new_path(spark, "t")
    token_store.write(none, empty)
    assert token_store.read_documents(spark, empty).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_odd_rows(spark, odd, none):
    more = spark.createDataFrame([(20, "a b c a b c d\na b c\n\na b c\r\n#$ |x"), (21, "x " * 60), (22, "the cat sat on the mat and " * 3), (23, "a b c\x1cd \x0b e")], "doc_id long, text string")
    rows = rules.apply_rules(odd.select("doc_id", "text").unionByName(more)).collect()
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts(r["text"]), r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert rules.apply_rules(odd).where("kept").count() == 0
    assert rules.apply_rules(none).count() == 0
    assert rules.apply_rules(odd.withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit("mine"))).count() == odd.count()


def test_rules_keep_clean_text(spark):
    draw = random.Random(5)
    text = " ".join(draw.choice(["the", "of", *["".join(draw.choices("abcdefgh", k=6)) for _ in range(4)]]) for _ in range(300))
    row = rules.apply_rules(spark.createDataFrame([(1, text), (2, " ".join(w + "###" for w in text.split()))], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["kept"] for r in row} == {1: True, 2: False}


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_chat_round_trip(spark):
    odd = "</s>[INST] ok [/INST] ~0 ~1 <|role|> ~~ <|next|><|end|> <|im_start|>"
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "user", odd, "x"), (1, 2, "assistant", odd, "x"), (1, 3, "assistant", None, "x"), (1, 3, "assistant", "tie", "x"), (2, 0, None, None, "x"), (3, 5, "assistant", "", "x"), (None, 0, "user", "no id", "x"), (4, 1, "b<|text|>", "after", "x"), (4, 0, "user", "first", "x")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(chats(spark, rows))).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in want]
        assert got[conv]["loss_texts"] == [x for _, r, x in want if r == "assistant"]
        body = re.sub(r"<\|(role|text|next|end)\|>", "", got[conv]["formatted"])
        assert not any(c in body for c, _ in chat.CONTROL)
    assert got[1]["n_blocks"] == 2 and got[1]["formatted"].count("<|role|>") == 2
    assert chat.format_chats(chats(spark, [])).count() == 0


def test_a_long_chat(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", "é" * (i % 7), "x") for i in range(5000)]
    r = chat.read_back(chat.format_chats(chats(spark, rows))).first()
    assert [t["text"] for t in r["turns"]] == [x for *_, x, _ in rows]
    assert r["loss_texts"] == ["é" * (i % 7) for i in range(0, 5000, 3)] and r["n_blocks"] == 2 * 1667 - 1 + 1 * (5000 % 3 > 1)
    sums = spark.range(1).select(chat.running(F.sequence(F.lit(1).cast("long"), F.lit(1000).cast("long"))).alias("s")).first()["s"]
    assert sums == [k * (k + 1) // 2 for k in range(1, 1001)]


def test_chat_plan_has_no_python(spark):
    plan = chat.format_chats(chats(spark, []))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_means_and_repeats(spark, odd, none):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"), F.lit("mine").alias("copy_no"))
    got = mix.replicate(docs, weights={"big": 1.0, "small": 1.0})
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 200
    per = [r["count"] for r in got.where("source = 'small'").groupBy("doc_id").count().collect()]
    assert max(per) >= 4  # a mean of two
    again = mix.replicate(docs.repartition(7), weights={"big": 1.0, "small": 1.0})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    keys = [r["shuffle_key"] for r in got.collect()]
    assert keys == sorted(keys)
    assert mix.replicate(docs, weights={"big": 1.0}).where("source = 'small'").count() == 0
    assert set(mix.replicate(odd).columns) == {*odd.columns, "copy_no", "shuffle_key"}
    assert mix.replicate(none).count() == 0


def test_mix_keeps_rates_above_one_table(spark):
    import math

    docs = spark.range(50_000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") < 5, "few").otherwise("many").alias("source"))
    weights = {"few": 0.5, "many": 0.5}
    assert {r["source"]: round(r["rate"]) for r in mix.rates(docs, weights=weights).collect()}["few"] == 5000
    got = mix.replicate(docs, weights=weights)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["few"] - 25_000) < 800 and abs(n["many"] - 25_000) < 800
    per = got.where("source = 'few'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("copy_no").alias("d"), F.max("copy_no").alias("last")).collect()
    assert len(per) == 5 and all(r["n"] == r["d"] == r["last"] for r in per)
    assert len({r["n"] for r in per}) > 1 and all(abs(r["n"] - 5000) < 6 * math.sqrt(5000) for r in per)
    one = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert abs(mix.replicate(one, rows=200_000).agg(F.count_distinct("copy_no")).first()[0] - 200_000) < 3000


def test_poisson_table(spark):
    import math

    for rate in (0.3, 5.0, 900.0):
        cdf = spark.range(1).select(mix.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
        if rate < 100:
            want = [sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k + 1)) for k in range(len(cdf))]
            assert np.allclose(cdf, want, atol=1e-12)
        mean = sum(k * p for k, p in enumerate(np.diff([0.0, *cdf])))
        assert abs(mean - rate) < 1e-6 * max(1, rate)


LANGS = {"de": "der hund und die katze sind nicht im haus", "en": "the dog and the cat are not in the house", "fr": "le chien et le chat ne sont pas dans la maison"}


def test_language_of_clear_texts(spark, odd, none):
    rows = [(i, LANGS[k] + f" {i}", k) for i, k in enumerate(["de", "en", "fr"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.learn(docs, F.col("doc_id") % 3 >= 0)
    got = lang_id.identify(docs.drop("lang"), model).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] and 0.5 < r["score"] <= 1 and not r["ambiguous"] for r in got)
    strange = {r["doc_id"]: r for r in lang_id.identify(odd, model).collect()}
    assert len(lang_id.identify(odd, model).collect()) == odd.count()
    assert all(strange[i]["lang_pred"] == "und" and strange[i]["score"] == 0 for i in (1, 2, 3))
    assert strange[7]["lang_pred"] != "und"
    assert lang_id.identify(none, model).count() == 0
    nothing = lang_id.learn(none, F.lit(True))
    assert {r["lang_pred"] for r in lang_id.identify(odd, nothing).collect()} == {"und"}


def test_letters_beyond_latin(spark):
    docs = spark.createDataFrame([(1, LANGS["en"], "en"), (2, LANGS["fr"], "fr")], "doc_id long, text string, lang string")
    model = lang_id.learn(docs, F.lit(True))
    texts = spark.createDataFrame([(1, "中文"), (2, "… \U0001f600 12"), (3, "Α")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in lang_id.identify(texts, model).collect()} == {1: False, 2: True, 3: False}


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 30):
        code = lang_id.codewords(k)
        apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        assert apart >= max(1, code.shape[1] // 4)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = lang_id.learn(docs, fold != 1)
    got = lang_id.identify(docs.where(fold == 1), model)
    n, ok, flagged = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred")), F.count_if("ambiguous")).first()
    assert ok / n > 0.98 and flagged / n < 0.02


def test_risk_is_not_negative_at_the_optimum():
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    good, bad = rng.normal(1, 1, (4000, d)), rng.normal(-1, 1, (1000, d))
    scorer = quality.fit(good[:2000], np.concatenate((good[2000:], bad[:500])), 0.8)
    s = scorer.score(np.concatenate((good, bad)))
    assert (s[:4000] >= 0.5).mean() > 0.97 and (s[4000:] < 0.5).mean() > 0.97
    p, n = quality.risk(*(np.log(x / (1 - x)) for x in (scorer.score(good[:2000]).clip(1e-9, 1 - 1e-9), scorer.score(np.concatenate((good[2000:], bad[:500]))).clip(1e-9, 1 - 1e-9))), 0.8)
    assert p >= 0 and n > -0.1


def test_quality_held_out(spark, odd, none):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    scorer = quality.learn(docs, labels, fold("id") != 2)
    rows = quality.score(docs, scorer).join(labels, "doc_id").where(fold("doc_id") == 2).select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    got = quality.score(odd, scorer).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality.score(none, scorer).count() == 0
    alone = quality.learn(none, labels.where("false"), F.lit(True))
    assert len({r["score"] for r in quality.score(odd, alone).collect()}) == 1


def test_bpe_classes_of_every_code_point_are_the_library_s():
    path = bpe.default_path()
    lib, own = Tokenizer.from_file(path), bpe.ByteBPE(path)
    lib.no_truncation()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x40000 <= c < 0xE0000]
    for lead in ("a", "1", "! ", " 's"):
        texts = ["".join(f"{lead}{c}'s" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
        for text, e in zip(texts, lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == e.ids


def test_bpe_text_of_a_new_letter_equals_the_library():
    path = bpe.default_path()
    lib, own = Tokenizer.from_file(path), bpe.ByteBPE(path)
    for text in ("\U000323b0's", "a՘b࢏ 1౜2", "₝₝'s <|endoftext|>՘'s"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_more_than_400_languages(spark):
    rng = random.Random(5)
    words = {f"x{k:03d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(430)}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(sorted(words) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.learn(docs, F.col("doc_id") < 860)
    assert len(model.langs) == 430 and len(model.weights) < 100
    got = lang_id.identify(docs.where("doc_id >= 860"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got)


def test_rows_without_an_id_draw_apart(spark):
    """A source whose rows have no id meets its weight like one whose rows have."""
    rows = [(i if i < 1000 else None, f"text {i}", "a" if i < 1000 else "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: r["count"] for r in mix.replicate(docs, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().collect()}
    assert all(880 < n < 1120 for n in got.values()) and len(got) == 2
    counts = mix.replicate(docs.where("doc_id is null"), weights={"b": 1.0}).groupBy("text").count().groupBy("count").count().count()
    assert counts > 2


def test_mix_of_rows_without_an_id_equals_its_sql(spark):
    import duckdb

    rows = [(i if i % 3 else None, f"text {i}" if i % 7 else None, None if i % 5 == 0 else "en", f"s{i % 4}", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    got = mix.replicate(docs).select("n_chars", "copy_no", "shuffle_key").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT n_chars, copy_no, shuffle_key FROM ({mix.sql()})").fetchall())
