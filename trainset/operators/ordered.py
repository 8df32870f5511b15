"""Positions, running totals and neighbours at scale.

A window without a partition key, or one keyed by a group that may hold a third of all
rows, puts that many rows into one task. Everything here splits such a sequence into
buckets that follow its order, works inside the buckets, and adds what the earlier
buckets contribute. The per-bucket table is narrow: one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_BUCKET_DIGITS = 4
MAX_BUCKETS = 16**HASH_BUCKET_DIGITS  # size bound of every ungrouped bucket table
_B = "__bucket"


def hash_bucket(order_hash: Column) -> Column:
    """Bucket of an md5-hex order key; follows its order and is uniform by construction."""
    return F.conv(F.substring(order_hash, 1, HASH_BUCKET_DIGITS), 16, 10).cast("int")


def range_bucket(df: DataFrame, column: str, splits: int = 64) -> Column:
    """Bucket of an integer column by sampled quantiles, refined linearly in between.

    One pass for approximate quantiles (at most ``splits`` numbers reach the driver);
    the boundaries only balance the work, results do not depend on them.
    """
    probs = [i / splits for i in range(splits + 1)]
    bounds = sorted(set(int(x) for x in df.approxQuantile(column, probs, 0.001)))
    if len(bounds) < 2:
        return F.lit(0)
    fine = MAX_BUCKETS // splits
    lows = bounds[:-1]
    widths = [max(hi - lo, 1) for lo, hi in zip(bounds[:-1], bounds[1:])]
    c = F.col(column)

    def slot(lo: int, hi: int) -> Column:
        """Index of the quantile interval, as a balanced tree of comparisons."""
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(lows[mid]), slot(lo, mid)).otherwise(slot(mid, hi))

    at = slot(0, len(lows))
    low = F.element_at(F.lit(lows), at + 1)
    width = F.element_at(F.lit(widths), at + 1)
    step = F.floor((c - low) * F.lit(fine) / width)
    return (at * F.lit(fine) + F.least(F.greatest(step, F.lit(0)), F.lit(fine - 1))).cast("int")


def with_running_total(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    out: str,
    weight: Column | None = None,
    by: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows before this one (0-based offset).

    ``bucket`` must not decrease along ``order``. With the default weight of one, ``out``
    is the row's dense position. ``total`` optionally adds the grand total as well.
    """
    return with_running_totals(df, order, bucket, {out: F.lit(1) if weight is None else weight}, by, {total: out} if total else {})


def with_running_totals(
    df: DataFrame, order: Sequence[str], bucket: Column, weights: dict[str, Column], by: Sequence[str] = (), totals: dict[str, str] | None = None
) -> DataFrame:
    """``with_running_total`` for several weights in one pass; ``totals`` maps the name of a grand total to its weight's."""
    by, totals = list(by), totals or {}
    base = df.withColumns({_B: bucket, **{f"__w_{o}": w.cast("long") for o, w in weights.items()}})
    per_bucket = base.groupBy(*by, _B).agg(*(F.sum(f"__w_{o}").alias(f"__sum_{o}") for o in weights))
    all_rows = Window.partitionBy(*(by or [F.lit(0)]))
    before = all_rows.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *by, _B,
        *(F.coalesce(F.sum(f"__sum_{o}").over(before), F.lit(0)).alias(f"__base_{o}") for o in weights),
        *(F.sum(f"__sum_{o}").over(all_rows).alias(t) for t, o in totals.items()),
    )
    if not by:
        carried = F.broadcast(carried)  # at most MAX_BUCKETS rows
    inside = Window.partitionBy(*by, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = {o: F.col(f"__base_{o}") + F.coalesce(F.sum(f"__w_{o}").over(inside), F.lit(0)) for o in weights}
    spent = [f"__{kind}_{o}" for o in weights for kind in ("w", "base")]
    return base.join(carried, [*by, _B]).withColumns(summed).drop(_B, *spent)


def with_hash_position(df: DataFrame, order_hash: str, tie: str, out: str, total: str | None = None) -> DataFrame:
    """Dense 0-based position in the order of a seeded hash column."""
    return with_running_total(df, [order_hash, tie], hash_bucket(F.col(order_hash)), out, total=total)


def with_seq_position(df: DataFrame, seq: str, out: str) -> DataFrame:
    """Dense 0-based position in the order of an integer sequence column."""
    return with_running_total(df, [seq], range_bucket(df, seq), out)


def scan_groups(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    *,
    block_size: int = 1024,
    position: str | None = None,
    previous: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Neighbour and group columns for ordered groups of any size.

    ``order`` is an integer that is unique inside a group. A group is cut into blocks of
    ``block_size`` consecutive order values, so no task ever sorts more than that many
    rows of one group.

    - ``position``: dense 0-based position in the group
    - ``previous``: last non-NULL value strictly before the row
    - ``latest``:   last non-NULL value up to and including the row
    - ``following``: first non-NULL value strictly after the row
    - ``totals``:   ``(function, column)`` with function in min/max/sum, over the group
    """
    by = list(by)
    previous, latest, following, totals = previous or {}, latest or {}, following or {}, totals or {}
    wanted = {**{f"p_{k}": c for k, c in previous.items()}, **{f"l_{k}": c for k, c in latest.items()},
              **{f"f_{k}": c for k, c in following.items()}}
    base = df.withColumn("__block", F.floor(F.col(order) / F.lit(block_size)))
    for name, column in wanted.items():
        base = base.withColumn(f"__{name}", column)
    o = F.col(order)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for name in previous:
        x = F.col(f"__p_{name}")
        aggs.append(F.max_by(x, F.when(x.isNotNull(), o)).alias(f"__sp_{name}"))
    for name in latest:
        x = F.col(f"__l_{name}")
        aggs.append(F.max_by(x, F.when(x.isNotNull(), o)).alias(f"__sl_{name}"))
    for name in following:
        x = F.col(f"__f_{name}")
        aggs.append(F.min_by(x, F.when(x.isNotNull(), o)).alias(f"__sf_{name}"))
    functions = {"min": F.min, "max": F.max, "sum": F.sum}
    for name, (fn, column) in totals.items():
        aggs.append(functions[fn](column).alias(f"__st_{name}"))
    blocks = base.groupBy(*by, "__block").agg(*aggs)

    group = Window.partitionBy(*by)
    along = group.orderBy("__block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = along.rowsBetween(1, Window.unboundedFollowing)
    carried = blocks.select(
        *by,
        "__block",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__c_n"),
        *[F.last(f"__sp_{n}", ignorenulls=True).over(before).alias(f"__cp_{n}") for n in previous],
        *[F.last(f"__sl_{n}", ignorenulls=True).over(before).alias(f"__cl_{n}") for n in latest],
        *[F.first(f"__sf_{n}", ignorenulls=True).over(after).alias(f"__cf_{n}") for n in following],
        *[functions[fn](f"__st_{n}").over(group).alias(n) for n, (fn, _c) in totals.items()],
    )
    inside = Window.partitionBy(*by, "__block").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    incl = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = inside.rowsBetween(1, Window.unboundedFollowing)
    added = [
        *([(F.col("__c_n") + F.row_number().over(inside) - 1).alias(position)] if position else []),
        *[F.coalesce(F.last(f"__p_{n}", ignorenulls=True).over(upto), F.col(f"__cp_{n}")).alias(n) for n in previous],
        *[F.coalesce(F.last(f"__l_{n}", ignorenulls=True).over(incl), F.col(f"__cl_{n}")).alias(n) for n in latest],
        *[F.coalesce(F.first(f"__f_{n}", ignorenulls=True).over(rest), F.col(f"__cf_{n}")).alias(n) for n in following],
        *[F.col(n) for n in totals],
    ]
    return base.join(carried, [*by, "__block"]).select(*df.columns, *added)
