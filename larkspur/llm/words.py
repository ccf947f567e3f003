"""Words of whole Arrow text columns as arrays: where they lie and 64-bit hashes, made for a batch at once.

Texts are UTF-8 and only ASCII bytes separate words, so all work is on bytes. A word's hash is a
polynomial over its lower-cased bytes modulo 2^64 with random byte values, mixed at the end: two
different words share a hash with a probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from larkspur.llm.common import sliced, utf8

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)
_VALUES = np.random.default_rng(42).integers(1, 2**63, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


#: Bytes that are part of a word, where ASCII white space separates; where only blanks and tabs do; of a search term.
SPACED = _table(b" \t\n\x0b\x0c\r")
BLANKED = _table(b" \t.,;:!?\n\x0b\x0c\r")
TERM = _table(bytes(c for c in range(128) if not chr(c).isalnum()))
#: Bytes at which a piece of text ends.
STOPS = ~_table(b".,;:!?\n\x0b\x0c\r")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers: dict[int, np.ndarray] = {}


def _power(factor: int, n: int) -> np.ndarray:
    """factor^0, factor^1, ..., kept at the largest size asked for up to a slice's."""
    found = _powers.get(factor)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 20), factor, np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if n <= 1 << 25:
            _powers[factor] = found
    return found[:n]


@dataclass
class Words:
    """The words of a slice of texts: ``text`` lower-cased bytes, ``starts`` and ``ends`` in it, ``row`` the text of each word, ``hashes``."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    n_rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def said(self, at: np.ndarray) -> list[str]:
        body = self.text.tobytes()
        return [body[a:b].decode() for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def words(column: pa.Array, inside: np.ndarray) -> Words:
    """The words of a text column, runs of bytes that ``inside`` holds; nulls have none."""
    body, at = utf8(column)
    body = _LOWER[body]
    here = inside[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[at] = True  # where texts meet
    starts = np.flatnonzero(here & (edge[:-1] | np.concatenate(([True], ~here[:-1]))))
    ends = np.flatnonzero(here & (edge[1:] | np.concatenate((~here[1:], [True])))) + 1
    row = np.searchsorted(at, starts, "right") - 1
    sums = np.zeros(len(body) + 1, np.uint64)
    np.take(_VALUES, body, out=sums[1:])
    sums[1:] *= _power(_FACTOR, len(body))
    np.cumsum(sums, out=sums)
    hashes = mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(body) + 1)[starts])
    return Words(body, starts, ends, row, hashes, len(at) - 1)


def word_slices(batches: Iterator[pa.RecordBatch], text: int, inside: np.ndarray, most: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Each slice of about ``most`` bytes of texts with its words."""
    for batch in sliced(batches, text, most):
        if batch.num_rows:
            yield batch, words(batch.column(text), inside)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``size`` words inside one text; a text of fewer words is one run, of none no run."""
    n = len(w.hashes)
    per = w.counts()
    first = np.concatenate(([0], np.cumsum(per)))
    out, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= size:
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h = mixed(h * np.uint64(_FACTOR) + w.hashes[k : n - size + 1 + k])
        inside = w.row[: n - size + 1] == w.row[size - 1 :]
        out, row = h[inside], w.row[: n - size + 1][inside]
    short = np.flatnonzero((per > 0) & (per < size))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = per[short] > k
            h[there] = mixed(h[there] * np.uint64(_FACTOR) + w.hashes[first[short[there]] + k])
        out, row = np.concatenate((out, mixed(h + np.uint64(size)))), np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, row
