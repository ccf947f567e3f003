import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "one two three four"), (7, LONG), (8, "café \U0001f600 中文 naïve"),
    (9, "<|endoftext|> hi <|endoftext|>"), (None, "no id here"), (None, None), (6, "one two three four"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, very long and repeated texts, and columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i else None, None if i == 3 else "s", -1, "x", "y", 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, score double").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
