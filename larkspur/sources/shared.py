"""The folder that the driver and all executors share, for state that outlives a task."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows that a task of ``dealt`` sorts or groups, so that its memory doesn't grow with the table.
ROWS_A_TASK = 250_000


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster[...] has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="larkspur-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, and sizes are known."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, ``n`` of them or so, by a hash of ``keys`` in as many tasks as hold ``ROWS_A_TASK`` each; never fewer than a shuffle has."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // ROWS_A_TASK)), *keys)


def ship(spark: SparkSession) -> None:
    """Lets Python workers started from here on import this package from where the driver has it.

    On a cluster the package travels with ``--py-files``; this only helps when it lies at the
    same path, as in local sessions whose working folder is elsewhere.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
