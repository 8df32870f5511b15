"""Registry behind ``queries()`` and ``oracle_sql()`` of the driver contract."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_MODULES = (
    "scans",
    "conversion",
    "validation",
    "cleaning",
    "mixing",
    "profiling",
    "rendering",
    "encoding",
    "inference",
    "images",
    "runs",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional SQL twin."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"trainset.queries.{module}")
