"""Exact profiles: rank percentiles, dataset statistics, token reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trainset.functions.tokens import estimate_tokens
from trainset.session import materialize

# ---- fixed values ----
RANKS = {"min": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
CANDIDATE_LENGTHS = (512, 1024, 2048, 4096, 8192, 16384)
SHORTEST_LENGTH, LONGEST_LENGTH = 512, 32768
# ----------------------
_RADIX = 65536


def rank_percentiles(df: DataFrame, value: str, by: Sequence[str] = (), above: int | None = None) -> DataFrame:
    """Per group: n, total and the values at index ``round_half_even(p·(n-1))`` of the sorted values.

    Exact without sorting rows: counts per distinct value, split by their upper and lower
    16 bits, so that no window sees more than 65536 rows of a group.
    Values must be non-negative integers below 2^31. ``above`` also counts the rows over that value.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("int").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__hi", F.floor(F.col("__v") / F.lit(_RADIX)))
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upper = (
        counts.groupBy(*by, "__hi")
        .agg(F.sum("__c").alias("__hc"))
        .select(
            *by,
            "__hi",
            F.coalesce(
                F.sum("__hc").over(group.orderBy("__hi").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("__base"),
            F.sum("__hc").over(group).alias("__n"),
        )
    )
    if not by:
        upper = F.broadcast(upper)  # at most 32768 rows
    inside = Window.partitionBy(*by, "__hi").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(upper, [*by, "__hi"]).withColumn("__upto", F.col("__base") + F.sum("__c").over(inside))
    picks = [
        F.min(F.when(F.col("__upto") > F.bround(F.lit(p) * (F.col("__n") - 1)), F.col("__v"))).cast("long").alias(name)
        for name, p in RANKS.items()
    ]
    over = [] if above is None else [F.sum(F.when(F.col("__v") > above, F.col("__c")).otherwise(F.lit(0))).alias("over")]
    return ranked.groupBy(*by).agg(
        F.sum("__c").alias("n"), F.sum(F.col("__v").cast("long") * F.col("__c")).alias("total"), *picks, *over
    )


def token_stats(df: DataFrame, length: str = "tokens", max_len: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rank percentiles, rounded mean and total of token counts, plus the share over ``max_len``."""
    out = rank_percentiles(df, length, by, above=max_len).withColumn("mean", F.bround(F.col("total") / F.col("n")).cast("long"))
    if max_len is None:
        return out
    counted = out.withColumn("over_max_len", F.coalesce("over", F.lit(0))).drop("over")
    return counted.withColumn("share_over_max_len", F.round(F.col("over_max_len") / F.col("n"), 4))


def coverage(
    df: DataFrame, length: str = "tokens", candidates: Sequence[int] = CANDIDATE_LENGTHS, by: Sequence[str] = ()
) -> DataFrame:
    """Share of samples that fit each candidate length: one aggregate, then unpivoted."""
    wide = df.groupBy(*by).agg(
        F.count(length).alias("samples"), *[F.count_if(F.col(length) <= n).alias(f"fit_{n}") for n in candidates]
    )
    pairs = F.array(*[F.struct(F.lit(n).cast("long").alias("max_len"), F.col(f"fit_{n}").alias("fit")) for n in candidates])
    return wide.select(*by, "samples", F.inline(pairs)).withColumn(
        "share", F.round(F.col("fit") / F.greatest("samples", F.lit(1)), 4)
    )


def with_token_estimate(df: DataFrame, chars: str = "chars", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, estimate_tokens(F.col(chars)))


def suggest_seq_len(stats: DataFrame, p90: str = "p90", context: int | None = None) -> DataFrame:
    """Smallest power of two that holds the 90th percentile, between 512 and the model context."""
    bucket = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col(p90), F.lit(1)))))
    length = F.greatest(F.lit(SHORTEST_LENGTH), F.least(F.lit(LONGEST_LENGTH), bucket)).cast("long")
    if context:
        length = F.least(length, F.lit(context).cast("long"))
    return stats.withColumn("max_seq_len", length)


def packed_block_estimate(stats: DataFrame, seq_len: Column, n: str = "n", mean: str = "mean") -> DataFrame:
    """Blocks that packing will give, from counts alone: ``ceil(n·mean/L)``, at least one."""
    blocks = F.ceil(F.col(n) * F.col(mean) / seq_len).cast("long")
    return stats.withColumn("blocks", F.greatest(F.lit(1).cast("long"), blocks))


def unpivot_metrics(row: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Wide numeric aggregates to ``(…keys, metric, value)``."""
    names = [c for c in row.columns if c not in keys]
    return row.select(
        *keys,
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
        ),
    )


def top_values(records: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """(field, value, n): the ``k`` most frequent values of each column, such as source, licence and language.

    All columns are counted in one pass; ties go to the lesser value, and empty values do not count.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = records.select(F.inline(pairs)).where(F.coalesce("value", F.lit("")) != "").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def dataset_stats(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Record-level statistics as ``(metric, value)`` rows.

    Expects one row per record with kind, fp, chars, assistant_turns, answer_chars,
    has_reasoning, has_tool_calls, has_system and meta_synthetic; see
    :func:`trainset.operators.traces.record_summary`.
    """
    by = list(by)
    needed = ("kind", "fp", "chars", "assistant_turns", "answer_chars", "has_reasoning", "has_tool_calls", "has_system", "meta_synthetic")
    records = materialize(records.select(*dict.fromkeys([*by, *needed])), "record-summary")  # narrow: texts are read once
    trace = F.col("kind") == "trace"
    share = lambda flag: F.when(
        F.count_if(trace) > 0, F.round(F.count_if(trace & F.col(flag)) / F.count_if(trace), 3)
    ).otherwise(F.lit(0.0))
    main = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in ("trace", "text", "completion", "image")],
        F.when(
            F.sum("assistant_turns") > 0, F.bround(F.sum("answer_chars") / F.sum("assistant_turns"))
        ).otherwise(F.lit(0)).alias("answer_chars_mean"),
        share("has_reasoning").alias("share_with_reasoning"),
        share("has_tool_calls").alias("share_with_tool_calls"),
        share("has_system").alias("share_with_system_prompt"),
        F.count_if(F.coalesce(F.col("meta_synthetic"), F.lit(False))).alias("synthetic"),
    )
    # Copies beyond the first: counted per fingerprint, so the hot ones collapse before the shuffle.
    dup = (
        records.groupBy(*by, "fp")
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy(*by)
        .agg(F.sum("extra").alias("duplicates"))
    )
    def named(stats: DataFrame, prefix: str) -> DataFrame:
        return stats.select(*by, *[F.col(r).alias(f"{prefix}_{r}") for r in RANKS])

    chars = named(rank_percentiles(records, "chars", by), "chars")
    turns = named(rank_percentiles(records.where(trace), "assistant_turns", by), "assistant_turns")
    out = unpivot_metrics(main, by)
    for extra in (dup, chars, turns):
        out = out.unionByName(unpivot_metrics(extra, by))
    return out.where(F.col("value").isNotNull())
