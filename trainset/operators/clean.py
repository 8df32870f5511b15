"""Length, emptiness, pattern and position filters; exact de-duplication; reject reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trainset.operators.ordered import with_seq_position

# First match wins, in this order.
CLEAN_ORDER = ("by_position", "empty", "short_answer", "too_long", "matched_pattern", "duplicate")


def length_reason(chars: Column, min_chars: int = 1, max_chars: int | None = None) -> Column:
    outside = chars < min_chars
    if max_chars:
        outside = outside | (chars > max_chars)
    return F.when(outside, F.lit("length_filter"))


def first_copies(df: DataFrame, fp: str = "fp", seq: str = "seq") -> DataFrame:
    """``(fp, seq)`` of the first record of every fingerprint.

    A plain minimum: copies collapse on the map side, so a fingerprint that holds a third of
    all rows costs one row per task.
    """
    return df.groupBy(fp).agg(F.min(seq).alias(seq))


def dedupe_exact(df: DataFrame, fp: str = "fp", seq: str = "seq") -> DataFrame:
    """Keep the first record of every fingerprint. ``seq`` must be unique."""
    return df.join(first_copies(df, fp, seq).select(seq), seq, "left_semi")


def mark_duplicates(df: DataFrame, reason: str = "reason", fp: str = "fp", seq: str = "seq") -> DataFrame:
    """Set ``duplicate`` on later copies among the rows that have no reason yet.

    The join runs on the unique ``seq``, never on the fingerprint, so it cannot be skewed.
    """
    winners = first_copies(df.where(F.col(reason).isNull()), fp, seq).select(seq, F.lit(True).alias("__first"))
    return (
        df.join(winners, seq, "left")
        .withColumn(
            reason,
            F.when(F.col(reason).isNull() & F.col("__first").isNull(), F.lit("duplicate")).otherwise(F.col(reason)),
        )
        .drop("__first")
    )


def check_pattern(pattern: str) -> str:
    """Fail on a broken expression before any job starts."""
    try:
        re.compile(pattern)
    except re.error as exc:
        raise ValueError(f"cannot read the pattern {pattern!r}: {exc}") from exc
    return pattern


def clean(
    df: DataFrame,
    *,
    drop_empty: bool = True,
    dedupe: bool = True,
    min_answer_chars: int = 0,
    max_chars: int = 0,
    drop_matching: str | None = None,
    drop_indices: Sequence[int] = (),
    seq: str = "seq",
) -> DataFrame:
    """Add ``reason`` (NULL = kept): by_position, empty, short_answer, too_long, matched_pattern, duplicate.

    Expects one row per valid record with all_chars, answer_chars, empty and fp, and for a
    pattern either the joined text (everything) or a ready flag (matched); see
    :mod:`trainset.operators.traces`. Positions count valid records in ``seq`` order.
    """
    if drop_matching:
        check_pattern(drop_matching)
        hit = F.col("everything").rlike(drop_matching) if "everything" in df.columns else F.col("matched")
    if drop_indices:
        df = with_seq_position(df, seq, "position")
    reason = F.coalesce(
        F.when(F.col("position").isin([int(i) for i in drop_indices]), F.lit("by_position"))
        if drop_indices
        else F.lit(None).cast("string"),
        F.when(F.col("empty"), F.lit("empty")) if drop_empty else F.lit(None).cast("string"),
        F.when(F.col("answer_chars") < min_answer_chars, F.lit("short_answer"))
        if min_answer_chars
        else F.lit(None).cast("string"),
        F.when(F.col("all_chars") > max_chars, F.lit("too_long")) if max_chars else F.lit(None).cast("string"),
        F.when(hit, F.lit("matched_pattern"))
        if drop_matching
        else F.lit(None).cast("string"),
    )
    marked = df.withColumn("reason", reason)
    return mark_duplicates(marked, seq=seq) if dedupe else marked


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNull()).drop("reason")


def reject_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many records each reason removed; kept records count under ``kept``."""
    return df.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def removed_examples(df: DataFrame, show: Column, seq: str = "seq", k: int = 3) -> DataFrame:
    return (
        df.where(F.col("reason").isNotNull())
        .select(F.col(seq), "reason", show.alias("shown"))
        .orderBy(seq)
        .limit(k)
    )


def guard_not_empty(df: DataFrame) -> bool:
    """Refuse to remove everything; False if nothing matched (leave the data as it is)."""
    row = df.agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("removed")).first()
    if row.removed and not row.kept:
        raise ValueError(f"no record would be left of {row.removed}")
    return bool(row.removed)
