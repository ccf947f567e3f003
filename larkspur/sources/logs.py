"""Raw logs in and out: tab-separated behaviours and catalogues, JSON lines, partitioned Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_FORMAT = "M/d/yyyy h:mm:ss a"

BEHAVIOURS = "impression_id BIGINT, user_id STRING, time STRING, history STRING, impressions STRING"
CATALOGUE = "item_id STRING, category STRING, subcategory STRING, title STRING, abstract STRING, url STRING, title_entities STRING, abstract_entities STRING"
EVENT = "impression_id BIGINT, user_id STRING, item_id STRING, clicked BOOLEAN, slot INT, ts TIMESTAMP"


def _tsv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", False).option("quote", "").csv(path)


def read_behaviours(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The headerless behaviour log; an empty history is null."""
    return _tsv(spark, path, BEHAVIOURS)


def read_catalogue(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The item tables of several splits as one, one row per item."""
    return dedupe_catalogue([_tsv(spark, p, CATALOGUE) for p in paths])


def dedupe_catalogue(parts: Sequence[DataFrame], key: str = "item_id") -> DataFrame:
    """All parts' rows by column name, the smallest row of each key."""
    rows = reduce(DataFrame.unionByName, parts)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def to_events(behaviours: DataFrame) -> DataFrame:
    """One row per shown item: the slate string split, with slot and click; times parsed."""
    shown = behaviours.select("impression_id", "user_id", F.try_to_timestamp("time", F.lit(TIME_FORMAT)).alias("ts"), F.posexplode(F.split(F.trim("impressions"), " +")).alias("slot", "pair"))
    cut = F.length("pair") - F.length(F.substring_index("pair", "-", -1)) - 1
    return shown.where("pair <> ''").select(
        "impression_id", "user_id", F.substring("pair", F.lit(1), cut).alias("item_id"), (F.substring_index("pair", "-", -1) == "1").alias("clicked"), "slot", "ts"
    )


def write_partitioned(df: DataFrame, path: str, by: str = "dt") -> None:
    """Overwrites ``path``; each day's rows meet in one task per file so a day isn't thousands of files."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def is_built(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job finished writing ``path``, on any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def to_json_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def from_json_lines(lines: DataFrame, schema: str | T.StructType, column: str = "value") -> DataFrame:
    """Rows of the JSON object in each line, whatever stands before it; lines without one are left out."""
    body = F.regexp_extract(column, r"\{.*", 0)
    parsed = lines.where(F.instr(column, "{") > 0).select(F.from_json(body, schema, {"mode": "PERMISSIVE"}).alias("__j"))
    return parsed.where("__j is not null").select("__j.*")
