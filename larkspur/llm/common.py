"""Helpers shared by the corpus operators: Arrow text buffers, row slices and column names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.shared import new_path, shared_dir, ship, staged

__all__ = ["column", "free_prefix", "new_path", "passed", "segment_sum", "shared_dir", "ship", "sliced", "staged", "utf8", "without"]

#: Text bytes that a worker turns into Python values at a time.
SLICE_BYTES = 4 << 20


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_prefix(*names: str) -> str:
    """A prefix that no given column name begins with, for columns that live inside a plan."""
    out = "__"
    while any(n.lower().startswith(out) for n in names):
        out += "_"
    return out


def without(columns: Sequence[str], made: Sequence[str]) -> list[str]:
    """``columns`` less those that an operator replaces, told apart as Spark does, without regard to case."""
    gone = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in gone]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying texts; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if column.null_count and at[-1]:  # a null may span bytes
        valid = np.asarray(column.is_valid())
        if np.any((at[1:] > at[:-1]) & ~valid):
            return utf8(column.fill_null(b""))
    return body, at


def sliced(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut, without copies, to about ``most`` bytes (of lists, elements) of column ``text``; one longer text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        values = batch.column(text)
        if not n or values.nbytes <= most:
            yield batch
            continue
        wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        ends = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + n + 1]
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each [offsets[i], offsets[i + 1])."""
    n = len(offsets) - 1
    if not n or not len(values):
        return np.zeros(n, values.dtype)
    out = np.zeros(n, np.result_type(values.dtype, np.int64) if values.dtype.kind in "bui" else values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=out.dtype)
    return out


def passed(docs: DataFrame, made: Sequence[str]) -> tuple[list[Column], list[str]]:
    """Columns of ``docs`` that pass through an Arrow function that makes ``made``, and their names.

    The function gets them as c0, c1, ..., since Spark reads the names of its input as expressions.
    """
    names = without(docs.columns, made)
    return [column(c).alias(f"c{i}") for i, c in enumerate(names)], names
