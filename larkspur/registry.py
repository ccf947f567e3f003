"""Queries and their DuckDB SQL, registered side by side."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FLAGSHIP = "training_examples"
#: Modules whose import registers queries.
MODULES = tuple(f"larkspur.plans.{m}" for m in ("ingest", "series", "examples", "scores", "metrics", "experiments", "reports", "retrieval", "monitoring", "relational", "streams", "stores"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a (spark, sf_dir) -> DataFrame function under ``name``, with its SQL if SQL can say it."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(f)
        def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)  # results carry wall-clock timestamps, as the tables do
            return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in out.dtypes if kind == "timestamp"})

        _QUERIES[name] = plain
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
