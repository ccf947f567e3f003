import random

import xxhash

from larkspur.llm import simhash


def plain(text):
    """The fingerprint by its definition, bit by bit."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps):
    """Smallest reachable id by brute force over all pairs."""
    ids = [i for i, _ in fps]
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i is not None and j is not None and (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_fingerprints_by_definition():
    for text in ("", "A", "a b", "One TWO three", "a b c d e f g " * 50, "café Été x y"):
        assert simhash.fingerprint(text.encode()) == plain(text), text


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps = [(r["doc_id"], plain(r["text"])) for r in docs.collect()]
    want = grouped(fps)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(fps)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]]
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in fps}


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(8):
            other = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                other ^= 1 << b
            fps.add(other)
    fps = sorted(fps)
    signed = [(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame(signed, "fp long, rep long")).collect()}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want and want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (150, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 150: 100}


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[6]["component_id"] == 5
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 4, 5, 7, 8, 9]
    assert simhash.keep_one(none).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    x, y = "alpha beta gamma delta epsilon", "one two three four five six"
    docs = spark.createDataFrame([(2, x, "a"), (5, x, "a"), (5, y, "a"), (5, y, "b")], "doc_id long, text string, source string")
    for parts in (1, 3):
        kept = sorted(map(tuple, simhash.keep_one(docs.repartition(parts)).select("doc_id", "text").collect()))
        assert kept == [(2, x), (5, y)]
    got = sorted({tuple(r) for r in simhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "component_id").collect()})
    assert got == [(2, 2), (5, 2), (5, 5)]


def test_copies_without_an_id_are_removed(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "e f g h"), (None, "e f g h")], "doc_id long, text string")
    assert sorted(map(str, simhash.keep_one(docs).collect())) == ["Row(doc_id=3, text='e f g h')", "Row(doc_id=None, text='a b c d')"]


def test_rows_without_an_id_link_others(spark):
    ids = spark.createDataFrame([(9, 0b1111), (None, 0b111111), (4, 0b11111111), (None, 1 << 40)], "id long, fp long")
    got = {r["fp"]: (r["component_id"], r["n_links"]) for r in simhash._classes(ids).collect()}
    assert got == {0b1111: (4, 1), 0b111111: (4, 2), 0b11111111: (4, 1), 1 << 40: (None, 0)}
