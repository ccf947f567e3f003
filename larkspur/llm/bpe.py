"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by concatenation.

A text is cut at added tokens, then by the pre-tokenizer's pattern. The bytes of a piece form a
doubly linked list of symbols. A heap holds (rank, position) of every adjacent pair that has a
merge; an entry whose pair is no longer the one at its position is stale and skipped. Pieces
repeat a lot, so a worker keeps a bounded table of encoded pieces; it changes no result.

Vocabulary and merges come from a ``tokenizers`` JSON file whose path is a parameter. Each
executor reads its own copy of that file.

The pattern's letters and numbers are those of the tokenizers library: what newer Unicode tables of
``regex`` have besides is told apart by asking the library, once in the driver.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows
get equal results; an empty table gives an empty table; other columns pass through, and the
columns the operators make replace those of the same name, whatever the others are called. A
very long text is encoded whole, in memory linear in its length; a batch is encoded in slices of
``SLICE_BYTES``, so one text above that is the most that a worker holds besides its table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import column as named
from larkspur.llm.common import passed, ship, sliced

#: Bytes of encoded pieces a worker keeps before it starts afresh, and the longest piece it keeps.
CACHE_BYTES, CACHE_LONGEST = 64 << 20, 128
#: What a table's entry takes besides the piece's characters and ids.
_ENTRY = 190
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?NUMBER+| ?OTHER+|\s+(?!\S)|\s+"
_CLASSES = {"LETTER": r"\p{L}", "NUMBER": r"\p{N}", "OTHER": r"[^\s\p{L}\p{N}]"}


def _pattern(classes: dict[str, str]) -> regex.Pattern:
    out = _PATTERN
    for name, said in classes.items():
        out = out.replace(name, said)
    return regex.compile(out, regex.V1)


@functools.cache
def unlike() -> str:
    """A class of the letters and numbers of this process's ``regex`` that are neither to the tokenizers library, whose Unicode is older.

    Only what Python's own Unicode doesn't know yet can differ; the library is asked for each of those.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    new = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn"))
    said = "".join(f"!{c}\n" for c in new)  # what is neither stays with the mark before it
    starts = {a for _, (a, _) in cut(said)}
    return _ranges([ord(c) for i, c in enumerate(new) if 3 * i + 1 not in starts])


def _ranges(points: list[int]) -> str:
    """Ascending code points as the ranges of a character class."""
    out: list[list[int]] = []
    for c in points:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for i, b in enumerate(rest):
        out[b] = chr(256 + i)
    return out


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self._make, self._bytes = make, 0

    def __missing__(self, piece: str) -> bytes:
        out = self._make(piece)
        if len(piece) <= CACHE_LONGEST:
            self._bytes += _ENTRY + len(piece) + len(out)
            if self._bytes > CACHE_BYTES:
                self.clear()
                self._bytes = _ENTRY + len(piece) + len(out)
            self[piece] = out
        return out


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1, which every Unicode version knows alike."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ByteBPE:
    def __init__(self, path: str, odd: str | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("only a plain byte-level BPE is read here")
        letters = byte_letters()
        vocab = model["vocab"]
        self.first = [vocab[x] for x in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        byte = {x: b for b, x in enumerate(letters)}
        size = max(max(vocab.values()), *(x["id"] for x in spec["added_tokens"]), 0) + 1
        self.said = [b""] * size
        for word, i in vocab.items():
            self.said[i] = bytes(byte[c] for c in word)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for word, i in self.added.items():
            self.said[i] = word.encode()
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._find = self._find_odd = _pattern(_CLASSES).findall
        odd = unlike() if odd is None else odd
        self._odd = re.compile(f"[{odd}]").search if odd else None
        if odd:  # only a text that holds one of these pays for the wider classes
            self._find_odd = _pattern({"LETTER": rf"[\p{{L}}--[{odd}]]", "NUMBER": rf"[\p{{N}}--[{odd}]]", "OTHER": rf"[[^\s\p{{L}}\p{{N}}]||[{odd}]]"}).findall
        self._pieces = _Pieces(self._piece)

    def merge(self, symbols: list[int]) -> list[int]:
        """``symbols`` after all merges, lowest rank first and leftmost on ties."""
        n, rank, made = len(symbols), self.rank.get, self.made
        shift = n.bit_length()
        low = (1 << shift) - 1
        heap, left = [], -1
        for i, right in enumerate(symbols):
            if left >= 0 and (r := rank(left << 20 | right)) is not None:
                heap.append(r << shift | i - 1)
            left = right
        if not heap:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i, r = top & low, top >> shift
            j = after[i]
            if j >= n or (s := symbols[i]) < 0 or rank(s << 20 | symbols[j]) != r:
                continue  # stale
            s = symbols[i] = made[r]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank(s << 20 | symbols[k])) is not None:
                    push(heap, q << shift | i)
            h = before[i]
            if h >= 0 and (q := rank(symbols[h] << 20 | s)) is not None:
                push(heap, q << shift | h)
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> bytes:
        first = self.first
        ids = self.merge([first[b] for b in piece.encode()])
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        ids, find = self._pieces.__getitem__, self._find
        if self._odd is not None and not _latin(text) and self._odd(text):
            find = self._find_odd
        if self._cut is None or not any(x in text for x in self.added):
            return b"".join(map(ids, find(text)))
        out = []
        for part in self._cut.split(text):
            out.append(int(self.added[part]).to_bytes(4, "little") if part in self.added else b"".join(map(ids, find(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        said = b"".join(map(self.said.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return said.decode("utf-8", "replace").encode()


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, odd: str | None = None) -> ByteBPE:
    """The worker's encoder for a file, read once; the driver says which characters are ``odd``."""
    odd = unlike() if odd is None else odd
    if (path, odd) not in _LOADED:
        _LOADED[path, odd] = ByteBPE(path, odd)
    return _LOADED[path, odd]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _over_text(df: DataFrame, column: str, kind: str, made: list[tuple[str, str]], make: Callable) -> DataFrame:
    """``df`` with columns that ``make`` computes from a batch of one column; the others pass through."""
    ship(df.sparkSession)
    names = [n for n, _ in made]
    kept, columns = passed(df, names)
    value = named(column)
    source = F.coalesce(value.cast(kind), F.lit("").cast(kind) if kind == "string" else F.array().cast(kind))
    schema = T.StructType([*[df.schema[c] for c in columns], *T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in made)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(columns)):
            arrays = make(batch.column(len(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *arrays], [*columns, *names])

    return df.select(*kept, source.alias("in")).mapInArrow(run, schema)


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` array<int>."""
    path, odd = path or default_path(), unlike()

    def make(texts: pa.Array) -> list[pa.Array]:
        bpe = loaded(path, odd)
        return [_lists([bpe.encode(t) for t in texts.to_pylist()])]

    return _over_text(docs, text_col, "string", [(ids_col, "array<int>")], make)


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``, the text of the ids."""
    path, odd = path or default_path(), unlike()

    def make(ids: pa.Array) -> list[pa.Array]:
        bpe = loaded(path, odd)
        return [pa.array([bpe.decode(np.array(x, "<u4").tobytes()).decode() for x in ids.to_pylist()], pa.string())]

    return _over_text(rows, ids_col, "array<int>", [(text_col, "string")], make)


def round_trip(docs: DataFrame, path: str | None = None, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 (and ids), encoded and decoded in one pass."""
    path, odd = path or default_path(), unlike()

    def make(texts: pa.Array) -> list[pa.Array]:
        bpe = loaded(path, odd)
        parts = [bpe.encode(t) for t in texts.to_pylist()]
        digest = [hashlib.sha256(p).hexdigest() for p in parts]
        told = [hashlib.sha256(bpe.decode(p)).hexdigest() for p in parts]
        return [pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(digest, pa.string()), pa.array(told, pa.string()), *[_lists(parts)] * with_ids]

    made = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *[("ids", "array<int>")] * with_ids]
    return _over_text(docs, text_col, "string", made, make)
