"""Language identification by error-correcting output codes over n-grams.

Every language has a codeword of bits. For each bit a binary n-gram classifier, a log-odds
weight per hashed byte n-gram, learns to tell the languages with a 1 from those with a 0. A text's
margin for a bit is the mean weight of its n-grams. Loss-weighted decoding sums a logistic loss
of margin x bit, weighted by how well the bit's classifier did on its training texts, for each
codeword and chooses the nearest; where the second nearest is close, the text is ambiguous.

Counts of n-grams for learning come from a bounded sample of labelled rows (``PER_LANG`` texts a
language in expectation, chosen by a hash of their id), added up a language at a time in ``TASKS``
tasks and stored. The driver reads them a few times, a language at a time, so that it holds ``BUCKETS``
weights a bit, and bits grow with the logarithm of the number of languages, which has no bound. Whole
texts are learned and scored.

Defined results: a null text or one without a letter is ``und`` with score 0 and not ambiguous;
rows without a language teach nothing; with no labelled text every text is ``und``; repeated
rows get equal results; ties go to the language first in the alphabet; an empty table gives an
empty table; other columns pass through under any name, except those of the names made here. A
very long text is read whole, in memory linear in its length; batches are read in slices.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import column, passed, segment_sum, ship, sliced, staged, utf8

BUCKETS = 1 << 16
PER_LANG = 1500
TASKS = 16
#: Up to so many languages, the best of several random codes is taken; beyond, the first.
COMPARED = 2000
#: Margins are mean log-odds; this makes the logistic loss and the score sharp enough.
SHARPNESS = 8.0
AMBIGUOUS = 0.6
UND = "und"
#: The columns that ``identify`` makes.
MADE = ("lang_pred", "score", "ambiguous", "margins")
_PIECE = 1 << 20

#: Byte -> class: 0 for what is no letter, letters in lower case, bytes of longer characters as they are.
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def grams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 3 and 4 bytes that start at each byte; 0 where there is none.

    An n-gram lies within one text and isn't blank at both ends.
    """
    n = len(body)
    c = _CLASS[body]
    upper = np.flatnonzero((body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[:-1] == 0xC3)) + 1  # Latin-1 capitals
    c[upper] += 0x20
    c = np.concatenate((c, np.zeros(3, np.uint32)))
    three = c[:n] * np.uint32(0x9E3779B1) + c[1 : n + 1] * np.uint32(0x85EBCA77) + c[2 : n + 2] * np.uint32(0xC2B2AE3D)
    four = three + c[3 : n + 3] * np.uint32(0x27D4EB2F)
    out = []
    for k, h in ((3, three), (4, four)):
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        g = (h >> np.uint32(16)).astype(np.uint16) | np.uint16(1)
        g[(c[:n] == 0) & (c[k - 1 : n + k - 1] == 0)] = 0
        for back in range(1, k):  # windows that leave their text
            at = offsets[1:] - back
            g[at[at >= offsets[:-1]]] = 0
        out.append(g)
    return out[0], out[1]


def _pieces(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _PIECE bytes; one longer text is a range of its own."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _PIECE, "right")) - 1)
        yield a, b
        a = b


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code up to five languages, beyond that random columns."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        # Every split of the languages in two, once: language 0 always has a 1.
        columns = [x for x in itertools.product((1, -1), repeat=k - 1) if min(x) < 0]
        return np.array([(1, *x) for x in columns], np.int8).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(k)))
    best, most = None, -1
    for _ in range(64 if k <= COMPARED else 1):
        code = rng.choice(np.array([1, -1], np.int8), (k, bits))
        same = code.astype(np.float32) @ code.T.astype(np.float32) if k <= COMPARED else np.zeros((1, 1))
        apart = ((bits - same) / 2 + bits * np.eye(len(same))).min()
        if apart > most and (np.abs(code.sum(0)) < k).all():
            best, most = code, apart
    if best is None:
        raise ValueError("no code found")
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x BUCKETS
    trust: np.ndarray  # bits

    def margins(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x bits mean weights, number of n-grams)."""
        n = len(offsets) - 1
        out, count = np.zeros((n, len(self.code.T)), np.float64), np.zeros(n, np.int64)
        for a, b in _pieces(body, offsets):
            own = offsets[a : b + 1] - offsets[a]
            for g in grams(body[offsets[a] : offsets[b]], own):
                count[a:b] += segment_sum(g > 0, own)
                for bit, w in enumerate(self.weights):
                    out[a:b, bit] += segment_sum(w[g], own)
        return out / np.maximum(count, 1)[:, None], count

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score, ambiguous) of rows of margins."""
        if not self.langs:
            return np.zeros(len(margins), np.int64), np.zeros(len(margins)), np.zeros(len(margins), bool)
        # A bit's loss has two values, one for a codeword's 1 and one for its -1; einsum sums every row in the same order.
        one, none = (np.logaddexp(0, s * SHARPNESS * margins) * self.trust for s in (-1, 1))
        loss = np.einsum("ib,kb->ik", one, (self.code > 0).astype(float)) + np.einsum("ib,kb->ik", none, (self.code < 0).astype(float))
        e = np.exp(loss.min(1, keepdims=True) - loss)
        p = e / e.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = p[np.arange(len(p)), best] if len(p) else np.zeros(0)
        return best, score, (score < AMBIGUOUS) & (len(self.langs) > 1)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, of rows in order of their language."""
    held, counts = None, np.zeros(BUCKETS, np.int64)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([counts.tobytes()], pa.binary())], ["lang", "counts"])

    for batch in sliced(batches, 1):
        body, offsets = utf8(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            if lang != held:
                if held is not None:
                    yield told()
                held, counts = lang, np.zeros(BUCKETS, np.int64)
            text = body[offsets[i] : offsets[i + 1]]
            for g in grams(text, np.array([0, len(text)])):
                counts += np.bincount(g, minlength=BUCKETS)
    if held is not None:
        yield told()


def learn(docs: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """A model from about ``per_lang`` texts of each language among the rows where ``teaches`` holds."""
    ship(docs.sparkSession)
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"), teaches.alias("teaches"))
    rows = rows.where("teaches and lang is not null and text is not null")
    sizes = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-sizes")
    part = F.xxhash64(F.lit("lang"), F.col("id")).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))
    sample = rows.join(sizes, "lang").where(part < per_lang / F.col("n")).select("lang", "text", F.pmod(F.xxhash64("id"), F.lit(TASKS)).alias("task"))
    counted = sample.repartition(TASKS, "lang", "task").sortWithinPartitions("lang").select("lang", "text").mapInArrow(_count_grams, "lang string, counts binary")
    counted = staged(counted, "lang-counts").orderBy("lang")

    def each() -> Iterator[tuple[str, np.ndarray]]:
        for lang, same in itertools.groupby(counted.toLocalIterator(), key=lambda r: r["lang"]):
            yield lang, sum(np.frombuffer(r["counts"], np.int64) for r in same)

    return fit(each)


def _share(counts: np.ndarray) -> np.ndarray:
    out = counts.astype(np.float64)
    out[0] = 0
    return (out + 0.5 / BUCKETS) / (out.sum() + 0.5)


def fit(counts: Mapping[str, np.ndarray] | Callable[[], Iterable[tuple[str, np.ndarray]]]) -> Model:
    """Log-odds weights of each bit from the n-gram counts of each language, a mapping or a function.

    ``counts()`` gives (language, counts) once each, in one order; it is read three times, and no
    more than one language's counts is held at a time.
    """
    if isinstance(counts, Mapping):
        counts = counts.items
    langs = sorted(k for k, c in counts() if c[1:].sum())
    code = codewords(len(langs))
    if not langs:
        return Model([], code, np.zeros((1, BUCKETS), np.float32), np.ones(1))
    spot = {k: i for i, k in enumerate(langs)}
    ones, every = np.zeros((code.shape[1], BUCKETS)), np.zeros(BUCKETS)
    for lang, c in counts():
        if lang in spot:
            share = _share(c)
            every += share
            ones[code[spot[lang]] > 0] += share
    n_ones = (code > 0).sum(0)
    weights = np.zeros((code.shape[1], BUCKETS))
    for bit in np.flatnonzero(n_ones < len(langs)):
        rest = (every - ones[bit]) / (len(langs) - n_ones[bit])
        weights[bit] = np.clip(np.log((ones[bit] / max(n_ones[bit], 1) + 1e-6) / (np.maximum(rest, 0) + 1e-6)), -6, 6)
    weights[:, 0] = 0
    # The mean margin of a language's own texts says how far a classifier can be trusted, and centres it.
    own = np.zeros((len(langs), code.shape[1]))
    first = np.zeros(len(langs))
    for lang, c in counts():
        if lang in spot:
            share = _share(c)
            own[spot[lang]], first[spot[lang]] = weights @ share, share[0]
    for bit, column in enumerate(code.T):
        if (column < 0).any():
            low, high = own[column < 0, bit].max(), own[column > 0, bit].min()
            middle = (low + high) / 2 if high > low else own[:, bit].mean()
            weights[bit, 1:] -= middle
            own[:, bit] -= middle * (1 - first)
    trust = np.maximum((own * code).min(0), 0.05)
    return Model(langs, code, weights.astype(np.float32), trust / trust.sum() * len(trust))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, ambiguous and margins (the bits' mean weights)."""
    ship(docs.sparkSession)
    made = T.StructType.fromDDL("lang_pred string, score double, ambiguous boolean, margins array<float>")
    kept, columns = passed(docs, made.names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a bit, and a row of bits a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches, len(columns)):
            texts = batch.column(len(columns))
            body, offsets = utf8(texts)
            letters = segment_sum(_CLASS[body] > 0, offsets) > 0
            for i in np.flatnonzero(letters & (segment_sum((body | 0x20) - np.uint8(97) < 26, offsets) == 0)).tolist():
                letters[i] = any(map(str.isalpha, texts[i].as_py()))
            letters &= len(m.langs) > 0
            margins, _ = m.margins(body, offsets)
            best, score, close = m.decode(margins)
            lang = [m.langs[b] if x else UND for b, x in zip(best.tolist(), letters.tolist(), strict=True)]
            arrays = [
                pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(close & letters),
                pa.array(list(margins.astype(np.float32)), pa.list_(pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *arrays], [*columns, *made.names])

    told = docs.select(*kept, column(text_col).cast("string").alias("text"))
    return told.mapInArrow(run, T.StructType([*[docs.schema[c] for c in columns], *made.fields]))
