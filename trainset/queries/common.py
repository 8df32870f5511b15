"""Shared inputs of the registered queries and SQL snippets of their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trainset.functions.text import WHITESPACE, strip
from trainset.operators.convert import convert_text
from trainset.operators.normalize import normalize_columns
from trainset.operators.traces import text_fingerprint
from trainset.queries.registry import query, table

__all__ = ["F", "DataFrame", "SparkSession", "WS", "query", "table", "strip", "text_records", "long", "SEED_SQL"]

WS = "'" + WHITESPACE + "'"  # SQL literal with the white-space characters that trimming removes


def long(c):
    return c.cast("long")


def SEED_SQL(seed, *keys: str) -> str:
    """md5 order key in SQL, equal to ``seeded_hash``."""
    return "md5('" + str(seed) + "'" + "".join(f" || ':' || CAST({k} AS VARCHAR)" for k in keys) + ")"


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as flat text records: seq, source, lang, text, chars, fp and the first error."""
    docs = table(spark, sf_dir, "documents")
    raw = convert_text(docs, "text", seq="doc_id", keep=("source", "lang"))
    return (
        normalize_columns(raw)
        .withColumn("chars", F.length("text").cast("long"))
        .withColumn("fp", text_fingerprint(F.col("text")))
    )
