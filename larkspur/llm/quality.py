"""A quality classifier learned from positive and unlabelled texts.

Trusted positives are texts labelled good; unlabelled texts are web text of unknown quality. With
the class prior p, the risk of a scorer g under the logistic loss l is

    p * mean l(g(x+)) + max(0, mean l(-g(xu)) - p * mean l(-g(x+)))

whose second term is the unbiased estimate of the risk on negatives, kept from going below zero
(where it does, the step undoes it). No label of a bad text is used: the prior, too, is estimated
from positives and unlabelled texts alone. A plain classifier of the one against the other is
fitted on half of each; over the other half, the share of unlabelled texts above a threshold
divided by that of positives is the prior where no negative lies above the threshold, and more
elsewhere. The threshold of the least ratio, with a margin for sampling error that grows as fewer
positives are left, gives the estimate (best bin estimation); the halves then change places. The
risk needs a prior within (0, 1), so an estimate at an end is moved inside by one text in n + 2.

The scorer is linear in statistics of the whole text: shares of byte classes, word and line
lengths, repeated words and lines. Fitting takes a bounded sample, ``POSITIVES`` and
``UNLABELLED`` texts in expectation, chosen by a hash of their id; only their statistics reach
the driver. Scoring covers every text.

Defined results: null and empty texts have all statistics zero and get that point's score;
repeated rows get equal scores; without a positive the prior alone is the score of every text;
labels of ids that aren't there teach nothing; a document labelled twice counts as often; an
empty table gives an empty table; other columns pass through under any name, except those of the
names made here. A very long text is measured whole, in memory linear in its length; batches are
measured in slices. Without an unlabelled text or a positive the prior is one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import column, passed, segment_sum, ship, sliced, staged, utf8

POSITIVES = 8_000
UNLABELLED = 16_000
#: Score from which a text is predicted good.
GOOD = 0.7

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&<>@^~_=+\\/{}[]", "bar": b"|", "shout": b"!?", "stop": b".", "comma": b",;:", "quote": b"\"'()-", "space": b" \t\x0b\x0c\r"}
FEATURES = (*[f"{k}_per_word" for k in _KINDS], "high_per_word", "log_words", "word_bytes", "log_line_words", "new_words", "repeated_lines", "upper_share", "symbol_share", "blank")


def statistics(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    counts = {k: segment_sum(np.isin(np.arange(256), np.frombuffer(v, np.uint8))[body], offsets).astype(np.float64) for k, v in _KINDS.items()}
    counts["high"] = segment_sum(body >= 0xC0, offsets).astype(np.float64)
    newline = segment_sum(body == 10, offsets).astype(np.float64)
    data = body.tobytes()
    words, kinds, lines, again = (np.zeros(n) for _ in range(4))
    for i in range(n):
        text = data[offsets[i] : offsets[i + 1]]
        w = text.split()
        words[i], kinds[i] = len(w), len(set(w))
        rows = [x for x in text.split(b"\n") if x.strip()]
        lines[i] = len(rows)
        again[i] = len(rows) - len(set(rows))
    per = np.maximum(words, 1)
    letters = counts["upper"] + counts["lower"] + counts["high"]
    out = [np.minimum(counts[k] / per, 20.0) for k in (*_KINDS, "high")]
    out += [
        np.log1p(words), np.minimum((size - counts["space"] - newline) / per, 40.0), np.log1p(words / np.maximum(lines, 1)),
        # Texts differ in length, so distinct words are held against a power of the number of words.
        kinds / np.maximum(words, 1) ** 0.9, again / np.maximum(lines, 1), counts["upper"] / np.maximum(letters, 1),
        np.minimum((counts["symbol"] + counts["bar"] + counts["shout"]) / per, 1.0), (words == 0).astype(np.float64),
    ]
    return np.stack(out, 1) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-g.clip(-50, 50)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, estimated negative part) of the risk at these outputs of g."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(positive), loss(-unlabelled) - prior * loss(-positive)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, by best bin estimation over two halves."""
    n = min(len(positive), len(unlabelled))
    if n < 4:
        return 0.5
    found = []
    for here in (0, 1):
        plain = fit(positive[here::2], unlabelled[here::2], 0.5, steps=400, plain=True)
        p, u = (np.sort(plain.score(x[1 - here :: 2])) for x in (positive, unlabelled))
        at = np.unique(p)
        above_p, above_u = (1 - np.searchsorted(x, at, "left") / len(x) for x in (p, u))
        error = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (p, u))
        best = np.argmin((above_u + 1.01 * error) / above_p)
        found.append(above_u[best] / above_p[best])
    least = 1 / (len(unlabelled) + 2)
    return float(min(max(np.mean(found), least), 1 - least))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-3, plain: bool = False) -> Scorer:
    """Minimises the non-negative risk by Adam over all rows at once, from zero, so runs agree.

    With ``plain`` unlabelled rows stand for negatives as they are.
    """
    both = np.concatenate((positive, unlabelled))
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1.0
    p, u = (((x - mean) / scale).clip(-8, 8) for x in (positive, unlabelled))
    p, u = (np.concatenate((x, np.ones((len(x), 1))), 1) for x in (p, u))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-z.clip(-50, 50)))
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        _, negative = risk(gp, gu, prior)
        d_positive = prior * -(p * (1 - sigmoid(gp))[:, None]).mean(0)
        d_negative = (u * sigmoid(gu)[:, None]).mean(0)
        if plain:
            negative, d_negative = 0.0, (1 - prior) * d_negative
        else:
            d_negative = d_negative - prior * (p * sigmoid(gp)[:, None]).mean(0)
        step = d_positive + d_negative if negative >= 0 else -d_negative
        step[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Scorer(mean, scale, w[:-1], float(w[-1]), prior)


def _measured(rows: DataFrame) -> np.ndarray:
    """The statistics of a bounded number of texts, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            x = statistics(*utf8(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"])

    got = sorted((r["id"], r["x"]) for r in rows.select("text", "id").mapInArrow(run, "id long, x array<double>").toLocalIterator())
    return np.array([x for _, x in got]).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer:
    """A scorer from rows where ``teaches``, a condition on the column ``id``, holds."""
    ship(docs.sparkSession)
    part = F.xxhash64(F.lit("pu"), F.col("id")).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))
    texts = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null").where(teaches)
    told = labels.select(column(id_col).cast("long").alias("id"), column(label_col).cast("int").alias("label")).where("label = 1 and id is not null").where(teaches).select("id")
    n_good, n = (df.agg(F.count(F.lit(1))).first()[0] for df in (told, texts.select("id")))
    chosen = staged(told.where(part < min(1.0, positives / max(n_good, 1))), "quality-positives")
    good = _measured(texts.join(chosen, "id"))
    web = _measured(texts.where(part < min(1.0, unlabelled / max(n, 1))))
    prior = estimated_prior(good, web)
    if not len(good) or not len(web):
        zero = np.zeros(len(FEATURES))
        return Scorer(zero, zero + 1, zero, float(np.log(prior / (1 - prior))), prior)
    return fit(good, web, prior)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    ship(docs.sparkSession)
    made = T.StructType.fromDDL("score double, predicted int")
    kept, columns = passed(docs, made.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(columns)):
            s = scorer.score(statistics(*utf8(batch.column(len(columns)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(s), pa.array((s >= GOOD).astype(np.int32))], [*columns, *made.names])

    told = docs.select(*kept, column(text_col).cast("string").alias("text"))
    return told.mapInArrow(run, T.StructType([*[docs.schema[c] for c in columns], *made.fields]))
