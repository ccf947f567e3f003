import random
import re
from collections import Counter

import pytest

from larkspur.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, most, covered=80):
    """Rows by the definition, over plain Python values (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for lang in {k[0] for k in found}:
        ranked = []
        for (own, p), a in found.items():
            if own != lang:
                continue
            around = [b for (o, q), b in found.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= covered * a for b in around):
                continue
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(ranked)[:most])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    stock = ["New York", "a b a b a", "the cat sat", "the cat ran", "to be or", "É é", "x, y", "end. Start", "tab\tword", "of of of of of"]
    return [(rng.choice(["en", "fr", None, "und"]), " ".join(rng.choice(stock) for _ in range(rng.randint(0, 12)))) for _ in range(150)]


@pytest.mark.parametrize("least,most,split", [(3, 1000, 20_000), (3, 5, 20_000), (2, 1000, 1), (5, 1000, 30), (30, 1000, 40)])
def test_against_brute_force(spark, texts, least, most, split):
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    want = brute(texts, least, most)
    assert found(collocations.collocations(docs, least=least, most=most, split=split)) == want and want


def test_odd_texts(spark, odd, none):
    want = brute([(r["lang"], r["text"]) for r in odd.collect()], 2, 100)
    assert found(collocations.collocations(odd, least=2, most=100)) == want
    assert collocations.collocations(none).collect() == []


def test_small_slices_and_flushes_change_nothing(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    monkeypatch.setattr(collocations, "_SLICE", 100)
    monkeypatch.setattr(collocations, "_GATHER", 20)
    assert found(collocations.collocations(docs, least=3, most=1000, split=30)) == brute(texts, 3, 1000)


def test_the_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from larkspur.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = found(queries.QUERIES["op11_collocations"](spark, sf_dir))
    assert got == sorted(con.execute(queries.ORACLE_SQL["op11_collocations"]).fetchall()) and got
