import random

import numpy as np
import pytest

from larkspur.llm import jaccard


def sets_of(docs, size=3):
    out = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])))
    return out


def brute(docs, percent=90):
    """Rows (id, size, component) by the definition: every pair of documents, over plain Python sets."""
    sets = sets_of(docs)
    parent = list(range(len(sets)))

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[top(x)] = top(y)
    names = {}
    for x, (i, _) in enumerate(sets):
        names.setdefault(top(x), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in names.items()}
    return sorted(((i, len(s), least[top(x)]) for x, (i, s) in enumerate(sets)), key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.fixture(scope="module")
def near():
    """A group of near copies with edits, pairs about the threshold, copies, short texts and a shared passage."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(30)]
    docs = []
    for k in range(130):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        docs.append(" ".join(w))
    for k in range(60):
        w = [word() for _ in range(rng.randint(1, 60))]
        docs += [" ".join(w), " ".join(w[:-1] + [word()]), " ".join(w + [word()]), " ".join(w + passage)]
    docs += ["One two three", "one TWO three", "one two", "one  two ", "one", None, "", " \n "] * 2
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("group,small,heavy,block", [(512, 32, 500, 256), (8, 4, 500, 16), (16, 2, 3, 256), (5, 1, 10**6, 7)])
def test_against_brute_force(spark, near, monkeypatch, group, small, heavy, block):
    for name, value in (("GROUP", group), ("SMALL", small), ("HEAVY", heavy), ("BLOCK", block), ("RANGE", 700)):
        monkeypatch.setattr(jaccard, name, value)
    docs = spark.createDataFrame(near, "doc_id long, text string").repartition(3)
    assert found(jaccard.near_duplicates(docs)) == brute(near)


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_other_thresholds(spark, near, percent):
    some = near[:150]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert found(jaccard.near_duplicates(docs, percent=percent)) == brute(some, percent)


def test_odd_texts(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(jaccard.near_duplicates(odd)) == brute(rows)
    assert jaccard.near_duplicates(none).collect() == []


def test_null_ids_link_others(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = [(None, text), (9, text + " x"), (4, "y " + text), (None, "alone here now"), (None, None)]
    got = found(jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


def test_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        x = np.sort(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2))
        assert (jaccard.unpacked(jaccard.packed(x)) == x).all()
    same = np.full(5, 7, np.uint64)
    assert (jaccard.unpacked(jaccard.packed(same)) == same).all()


def test_the_query(spark, sf_dir):
    from larkspur.llm import queries

    got = found(queries.QUERIES["op13_jaccard"](spark, sf_dir))
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])
