"""Dense matrices as files of contiguous rows, for readers that go by row number.

Rows are numbered in order of their id and cut into blocks. A block is one record of a Parquet
table: its first row, how many it has, and their float32 numbers, little-endian, row after row,
with a SHA-256. The manifest tells each block's place, so a reader fetches the blocks of the
rows it is asked for and no others, and a block that was damaged is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.candidates import matrix
from larkspur.operators.ranges import numbered
from larkspur.sources.shared import ship

BLOCK_ROWS = 1024
_BLOCK = "block long, first long, n int, width int, ids array<long>, data binary, sha256 string"


def write(vectors: DataFrame, path: str, id_col: str = "item", vector_col: str = "vector", block_rows: int = BLOCK_ROWS) -> None:
    """Dumps (id, vector), all of one length, none null, under ``path``: blocks, and a manifest of their places."""
    if block_rows < 1:
        raise ValueError("block_rows must be positive")
    ship(vectors.sparkSession)
    rows = numbered(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")), ["id"], "position")

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        data = matrix(table["vector"], np.dtype("<f4"))
        if np.isnan(data).any() or len(data) != table.num_rows:
            raise ValueError("a vector is missing or not whole")
        body = data.tobytes()
        first = table["position"][0].as_py()
        return pa.table(
            {
                "block": pa.array([first // block_rows], pa.int64()), "first": pa.array([first], pa.int64()), "n": pa.array([len(data)], pa.int32()), "width": pa.array([data.shape[1]], pa.int32()),
                "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.int64())), "data": pa.array([body], pa.binary()), "sha256": pa.array([hashlib.sha256(body).hexdigest()]),
            }
        )

    blocks = rows.withColumn("block", F.floor(F.col("position") / block_rows)).groupBy("block").applyInArrow(packed, _BLOCK)
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    told = vectors.sparkSession.read.parquet(f"{path}/blocks").select("block", "first", "n", "width", (F.col("first") * F.col("width") * 4).alias("offset"), "sha256", F.lit(block_rows).alias("block_rows"))
    told.write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(block, first, n, width, offset, sha256, block_rows); offset is where the block would begin in one file of all rows."""
    return spark.read.parquet(f"{path}/manifest")


def read_rows(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(position, id, vector) of the asked (position); positions beyond the dump are left out."""
    ship(spark)
    sizes = manifest(spark, path).agg(F.max("block_rows").alias("rows"))
    wanted = asked.select("position").distinct().join(F.broadcast(sizes)).select("position", F.floor(F.col("position") / F.col("rows")).alias("block"))  # one row
    wanted = wanted.groupBy("block").agg(F.collect_list("position").alias("positions"))  # a block's rows at most
    blocks = spark.read.parquet(f"{path}/blocks").join(wanted, "block").select("first", "n", "width", "ids", "data", "sha256", "positions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if hashlib.sha256(r["data"]).hexdigest() != r["sha256"]:
                    raise ValueError(f"the block from row {r['first']} isn't as it was written")
                data = np.frombuffer(r["data"], "<f4").reshape(r["n"], r["width"])
                at = np.array([p - r["first"] for p in r["positions"] if 0 <= p - r["first"] < r["n"]], np.int64)
                ids = np.array(r["ids"], np.int64)[at]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * r["width"]), pa.array(data[at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(at + r["first"]), pa.array(ids), lists], ["position", "id", "vector"])

    return blocks.mapInArrow(run, "position long, id long, vector array<float>")
