"""Seeded samples, mixing, upsampling and the train/eval split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trainset.functions.text import seeded_hash
from trainset.operators.ordered import hash_bucket

EVAL_MIN_RECORDS = 40  # default: smaller tables are all training data


@dataclass(frozen=True)
class Part:
    """One dataset of a mix: cap (0 or None = all of it) and integer upsampling factor."""

    name: str
    max_records: int | None = None
    repeat: int = 1


def sample_rows(df: DataFrame, n: int | None, seed: int = 42, key: Sequence[str] = ("seq",)) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash, in no order: a reproducible sample without replacement."""
    if n is None:
        return df
    if n < 1:
        return df.limit(0)
    return cap_groups(df.withColumn("__all", F.lit("all")), {"all": n}, "__all", seed, key).drop("__all")


def cap_groups(
    df: DataFrame, caps: dict[str, int | None], group: str, seed: int = 42, key: Sequence[str] = ("seq",)
) -> DataFrame:
    """Keep a seeded sample of at most ``caps[g]`` rows of every group ``g``; exact at any size.

    A histogram over the leading hash digits finds the bucket where a group's cap falls.
    Lower buckets are kept without ranking; only that one bucket's rows are ranked, about
    1/65536 of the group, so a dominating group never meets in one task.
    """
    capped = {name: int(cap) for name, cap in caps.items() if cap}
    if not capped:
        return df
    base = df.withColumn("__h", seeded_hash(seed, *[F.col(k) for k in key])).withColumn(
        "__b", hash_bucket(F.col("__h"))
    )
    limit = F.lit(None).cast("long")
    for name, cap in capped.items():
        limit = F.when(F.col(group) == name, F.lit(cap).cast("long")).otherwise(limit)
    counts = base.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(group).orderBy("__b")  # at most 65536 rows per group
    cut = (
        counts.withColumn("__upto", F.sum("__n").over(along))
        .withColumn("__limit", limit)
        .where(F.col("__upto") > F.col("__limit"))
        .groupBy(group)
        .agg(F.min_by(F.struct("__b", (F.col("__limit") - F.col("__upto") + F.col("__n")).alias("room")), "__b").alias("cut"))
        .select(group, F.col("cut.__b").alias("__cut"), F.col("cut.room").alias("__room"))
    )
    marked = base.join(F.broadcast(cut), group, "left")  # one row per capped part of the mix
    below = marked.where(F.col("__cut").isNull() | (F.col("__b") < F.col("__cut")))
    rank = Window.partitionBy(group, "__b").orderBy("__h", *key)
    edge = (
        marked.where(F.col("__b") == F.col("__cut"))
        .withColumn("__rank", F.row_number().over(rank))
        .where(F.col("__rank") <= F.col("__room"))
    )
    return below.select(*df.columns).unionByName(edge.select(*df.columns))


def upsample(df: DataFrame, factor: Column, copy: str = "copy") -> DataFrame:
    """Every row ``factor`` times (at least once), copies numbered from 1."""
    times = F.greatest(F.coalesce(factor.cast("int"), F.lit(1)), F.lit(1))
    return df.withColumn(copy, F.explode(F.sequence(F.lit(1), times)))


def check_mixable(df: DataFrame, kind: str = "kind") -> None:
    """Image records cannot be mixed with text records."""
    row = df.agg(
        F.count_if(F.col(kind) == "image").alias("images"), F.count_if(F.col(kind) != "image").alias("texts")
    ).first()
    if row.images and row.texts:
        raise ValueError("a mix holds images or texts, not both")
    if not row.images and not row.texts:
        raise ValueError("the mix is empty")


def mix(
    df: DataFrame, parts: Sequence[Part], seed: int = 42, dataset: str = "dataset", key: Sequence[str] = ("seq",),
    expand: bool = True,
) -> DataFrame:
    """Cap and upsample the parts of one table that has a ``dataset`` column.

    With ``expand=False`` the factor stays in a ``copies`` column, so that a later split can
    keep all copies of a record on one side.
    """
    names = [p.name for p in parts]
    if len(set(names)) != len(names):
        raise ValueError("the same dataset twice in one mix")
    chosen = df.where(F.col(dataset).isin(names))
    capped = cap_groups(chosen, {p.name: p.max_records for p in parts}, dataset, seed, [dataset, *key])
    factor = F.lit(1)
    for p in parts:
        factor = F.when(F.col(dataset) == p.name, F.lit(max(int(p.repeat), 1))).otherwise(factor)
    mixed = capped.withColumn("copies", factor.cast("int"))
    return upsample(mixed, F.col("copies")).drop("copies") if expand else mixed


def split_train_eval(
    df: DataFrame,
    eval_fraction: float = 0.05,
    eval_max: int = 300,
    seed: int = 42,
    key: Sequence[str] = ("seq",),
    total: DataFrame | None = None,
    min_records: int = EVAL_MIN_RECORDS,
) -> DataFrame:
    """Add ``split``: a seeded hold-out of ``min(eval_max, max(1, int(N·fraction)))`` rows.

    Fewer than ``min_records`` rows are all training data. ``key`` must identify a row. The hash of
    the last row held out is one number, so the rows themselves are only compared with it: a
    histogram over the leading hash digits finds its bucket, and only that bucket is ranked.
    ``total`` (one row, one number) replaces the row count N, e.g. to count upsampled copies.
    """
    if eval_fraction <= 0 or eval_max <= 0:
        return df.withColumn("split", F.lit("train"))
    n = (total if total is not None else df.agg(F.count(F.lit(1)).alias("n"))).toDF("n")
    size = n.select(
        F.when(F.col("n") < min_records, F.lit(0))
        .otherwise(
            F.least(F.lit(eval_max), F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(eval_fraction)).cast("int")))
        )
        .alias("size")
    )
    h = seeded_hash(f"split-{seed}", *[F.col(k) for k in key])
    hashed = df.select(h.alias("__h")).withColumn("__b", hash_bucket(F.col("__h")))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # at most 65536 rows
    upto = counts.withColumn("__upto", F.sum("__n").over(Window.orderBy("__b"))).withColumn("size", size.scalar())
    edge = upto.where(F.col("__upto") >= F.col("size")).agg(
        F.min_by(F.struct("__b", (F.col("size") - F.col("__upto") + F.col("__n")).alias("room")), "__b").alias("e")
    ).select("e.*")  # one row
    ranked = hashed.join(F.broadcast(edge), "__b").withColumn("__rank", F.row_number().over(Window.partitionBy("__b").orderBy("__h")))
    last = ranked.where(F.col("__rank") <= F.col("room")).agg(F.coalesce(F.max("__h"), F.lit("")).alias("h"))
    none = size.scalar() < 1
    return df.withColumn("split", F.when(~none & (h <= last.scalar()), F.lit("eval")).otherwise(F.lit("train")))


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-empty values; ties in value order."""
    return (
        df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "")
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(k)
    )
