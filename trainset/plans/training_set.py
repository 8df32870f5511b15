"""From datasets to a training set: mix, split, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trainset.operators.sampling import Part, mix, split_train_eval, upsample


def build_training_set(
    records: DataFrame,
    parts: Sequence[Part],
    *,
    eval_fraction: float = 0.05,
    eval_max: int = 300,
    seed: int = 42,
    compat: bool = False,
    dataset: str = "dataset",
    key: Sequence[str] = ("seq",),
) -> DataFrame:
    """Cap, split and upsample the named parts of ``records``; adds copy and split.

    All copies of a record stay on one side of the split: the hold-out is chosen among
    distinct records, sized by the number of copies as the reference sizes it. With
    ``compat=True`` the copies are split one by one, so a record can land on both sides.
    """
    capped = mix(records, parts, seed, dataset, key, expand=compat)
    if compat:
        return split_train_eval(capped, eval_fraction, eval_max, seed, [dataset, *key, "copy"])
    copies = capped.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))
    marked = split_train_eval(capped, eval_fraction, eval_max, seed, [dataset, *key], total=copies)
    return upsample(marked, F.col("copies")).drop("copies")


def training_set_report(mixed: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Rows, distinct records and characters per split and part."""
    distinct = F.count_if(F.col("copy") == 1)
    return mixed.groupBy("split", dataset).agg(
        F.count(F.lit(1)).alias("rows"), distinct.alias("records"), F.sum("chars").cast("long").alias("chars")
    )


def set_kind(mixed: DataFrame) -> DataFrame:
    """``mixed`` for more than one kind of record, else the kind."""
    row = mixed.agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    return row.select(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("mixed")).alias("kind"))
