import math
import re
from collections import Counter

from larkspur.llm import search

TERMS = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    """Rows (item, rank, doc, score) by the definition, over plain Python values."""
    counts = [(i, Counter(TERMS.findall((t or "").translate(LOWER)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), n in zip(counts, sizes, strict=True):
            score = 0
            for t in {*TERMS.findall((text or "").translate(LOWER))} & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // length)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "One two THREE"), (2, None), (3, ""), (4, "nothing, like; that"), (5, "café \U0001f600 lorem"), (6, "Lorem lorem")]


def test_against_brute_force(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for k in (1, 3, 50):
        assert found(search.search(odd, items, k)) == brute(rows, ITEMS, k)


def test_all_terms_give_the_same_as_the_asked_ones(spark, odd, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = found(search.search(odd, items, 4))
    monkeypatch.setattr(search, "MOST_SENT", 0)  # all postings are stored, and joined by a shuffle
    assert found(search.search(odd, items, 4)) == want


def test_equal_scores_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(9, 0, -1)] + [(10, "other text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same words")], "item_id long, text string")
    assert [r[2] for r in found(search.search(docs, items, 4))] == [1, 2, 3, 4]


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(none, items).collect() == []
    assert search.search(odd, items.where("false")).collect() == []


def test_the_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from larkspur.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = found(queries.QUERIES["op12_search"](spark, sf_dir))
    assert got == sorted(con.execute(queries.ORACLE_SQL["op12_search"]).fetchall(), key=str) and len(got) > 0
