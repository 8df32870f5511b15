"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trainset.session import materialize

__all__ = ["as_text", "crc_bucket", "materialize", "packed", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8 bytes, null as no bytes."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [v or "" for v in column.to_pylist()]


def crc_bucket(key: str, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(buckets), F.lit(-1)).cast("int")


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``: any names, dots included, pass through Arrow and come back by ``row.*``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
