"""Where training data came from, and how preference training went."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def register_source(datasets: DataFrame, added: DataFrame) -> DataFrame:
    """Extend a (name, source, synthetic) table: earlier sources stay, synthetic origin sticks."""
    both = datasets.unionByName(added)
    flags = both.groupBy("name").agg(F.bool_or("synthetic").alias("synthetic"))
    return both.select("name", "source").distinct().join(flags, "name")


def lineage(parts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets of every training set: one row per set and name, at the name's first position.

    ``parts``: training_set, name, pos. ``datasets``: name, source, synthetic, license.
    """
    first = parts.groupBy("training_set", "name").agg(F.min("pos").alias("pos"))
    return first.join(datasets, "name").withColumn("license", F.coalesce("license", F.lit("unknown")))


def lineage_report(lineage_rows: DataFrame) -> DataFrame:
    return lineage_rows.groupBy("training_set", "source", "license").agg(
        F.count(F.lit(1)).alias("datasets"), F.bool_or("synthetic").alias("synthetic")
    )


def preference_metrics(
    logps: DataFrame, beta: float = 0.1, label_smoothing: float = 0.0, by: Sequence[str] = (), digits: int = 5
) -> DataFrame:
    """Loss, rewards, accuracy and margin of pairs of summed log-probabilities.

    −log σ(x) is computed as ``max(−x, 0) + log1p(exp(−|x|))``, which cannot overflow.
    """
    won = F.lit(beta) * (F.col("policy_chosen") - F.col("ref_chosen"))
    lost = F.lit(beta) * (F.col("policy_rejected") - F.col("ref_rejected"))
    gap = F.lit(beta) * (
        (F.col("policy_chosen") - F.col("ref_chosen")) - (F.col("policy_rejected") - F.col("ref_rejected"))
    )
    nll = lambda x: F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    loss = nll(gap) if not label_smoothing else (1 - label_smoothing) * nll(gap) + label_smoothing * nll(-gap)
    mean = lambda c: F.round(F.avg(c), digits)
    return logps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        mean(loss).alias("loss"),
        mean(won).alias("rewards_chosen"),
        mean(lost).alias("rewards_rejected"),
        mean((won > lost).cast("double")).alias("rewards_accuracy"),
        mean(won - lost).alias("rewards_margin"),
    )
