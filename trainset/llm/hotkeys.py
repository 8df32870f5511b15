"""Joins whose key may be shared by a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LEAST = 10_000  # rows; rarer keys are never hot
PARTS = 1 << 16  # a hot key has at least this part of all rows, so there are no more hot keys than that


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], least: int = LEAST, parts: int = PARTS) -> DataFrame:
    """``rows`` inner-joined with ``facts`` (one row a key): facts of hot keys are broadcast, the rest is shuffled.

    A key is hot if at least ``least`` rows and one in ``parts`` of all have it, so at most ``parts`` facts are
    broadcast, and no task of the shuffle gets more than the rows of keys that are not hot.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = counts.where((F.col("_n") >= least) & (F.col("_n") * parts >= total)).select(*keys)
    hot_facts = F.broadcast(facts.join(F.broadcast(hot), keys, "left_semi"))
    return rows.join(hot_facts, keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(facts, keys))
