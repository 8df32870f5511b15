"""Training-run tables: metrics logs, status, error classes and stage chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from trainset.operators.ordered import scan_groups
from trainset.session import materialize

# ---- fixed values ----
HISTORY = 400
TREND_POINTS = 8
SMOOTHING = 0.9
TERMINAL = ("completed", "failed", "stopped", "cancelled", "crashed")
ERROR_CLASSES = (
    ("oom", "Lower the batch size or sequence length, or use a GPU with more memory."),
    ("auth", "The base model is gated: accept its licence and provide an access token."),
    ("disk", "The machine ran out of disk space."),
    ("nan", "The loss became NaN: lower the learning rate."),
    ("data", "No training example could be rendered: check the dataset preview."),
    ("network", "The model hub could not be reached."),
    ("deps", "The quantisation library is missing or broken."),
    ("error", "See the log for details."),
)
# ----------------------
_EMA_BLOCK = 512


def latest_status(metrics: DataFrame, job: str = "job_id", time: str = "time", tie: str = "step") -> DataFrame:
    """The last row of every job; partial maxima, so a busy job costs one row per task."""
    rest = [c for c in metrics.columns if c != job]
    last = F.max_by(F.struct(*rest), F.struct(time, tie)).alias("s")
    return metrics.groupBy(job).agg(last).select(job, "s.*")


def loss_trend(metrics: DataFrame, job: str = "job_id", step: str = "step", loss: str = "loss") -> DataFrame:
    """At most eight points of the last 400 losses of every job.

    Spark keeps only 400 rows per job on the map side before the shuffle (window group limit).
    """
    newest = Window.partitionBy(job).orderBy(F.desc(step))
    last = metrics.where(F.col(loss).isNotNull()).select(job, step, F.round(loss, 5).alias("loss")).withColumn("r", F.row_number().over(newest)).where(F.col("r") <= HISTORY)
    sizes = last.groupBy(job).agg(F.count(F.lit(1)).alias("n"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / TREND_POINTS)).cast("int")
    at = F.col("n") - F.col("r")  # 0-based, oldest first
    kept = last.join(sizes, job).withColumn("stride", stride).withColumn("i", at).where(F.pmod("i", "stride") == 0)
    picks = F.ceil(F.col("n") / F.col("stride"))
    return kept.where(F.col("i") / F.col("stride") >= picks - TREND_POINTS).select(job, step, F.round("loss", 3).alias("loss"))


def ema(metrics: DataFrame, job: str = "job_id", step: str = "step", loss: str = "loss", out: str = "smoothed") -> DataFrame:
    """Exponentially smoothed loss per row: the first value seeds, then 0.9 · old + 0.1 · new.

    The recurrence is linear, so it splits into blocks of 512 rows plus what earlier blocks
    carry in. The carry looks 14 blocks back: 0.9^(512·14) is below the smallest double, so of
    finite losses older blocks add exactly zero. NaN and infinity are not summed: their first steps
    in a job decide what every later row is. Rows without a loss (evaluations) are left out.
    ``step`` is an integer that is unique inside a job.
    """
    d = SMOOTHING
    inf, raw = F.lit(float("inf")), F.col(loss)
    odd = {"__nan": F.isnan(raw), "__up": raw == inf, "__down": raw == -inf}
    placed = scan_groups(
        metrics.where(raw.isNotNull()), [job], step, position="__i", totals={k: ("min", F.when(c, F.col(step))) for k, c in odd.items()}
    )
    reached = {k: F.coalesce(F.col(step) >= F.col(k), F.lit(False)) for k in odd}
    x = F.when(F.isnan(raw) | (F.abs(raw) == inf), F.lit(0.0)).otherwise(raw)
    j = F.pmod("__i", F.lit(_EMA_BLOCK))
    base = placed.withColumn("__b", F.floor(F.col("__i") / _EMA_BLOCK)).withColumn("__j", j)
    x = x * F.when(F.col("__i") == 0, F.lit(1.0)).otherwise(F.lit(1 - d))
    inside = Window.partitionBy(job, "__b").orderBy("__j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.pow(F.lit(d), F.col("__j")) * F.sum(x * F.pow(F.lit(d), -F.col("__j"))).over(inside)
    base = base.withColumn("__local", local)
    ends = base.groupBy(job, "__b").agg(F.max_by("__local", "__j").alias("__end"))
    lookback = math.ceil(746 / (-math.log(d) * _EMA_BLOCK))
    along = Window.partitionBy(job).orderBy("__b")
    carry = F.lit(0.0)
    for k in range(1, lookback + 1):
        carry = carry + F.coalesce(F.lag("__end", k).over(along), F.lit(0.0)) * F.lit(d ** (_EMA_BLOCK * (k - 1)))
    carried = ends.select(job, "__b", carry.alias("__carry"))
    finite = F.col("__local") + F.pow(F.lit(d), F.col("__j") + 1) * F.col("__carry")
    value = (
        F.when(reached["__nan"] | (reached["__up"] & reached["__down"]), F.lit(float("nan")))
        .when(reached["__up"], inf)
        .when(reached["__down"], -inf)
        .otherwise(finite)
    )
    return base.join(carried, [job, "__b"]).withColumn(out, value).drop("__i", "__b", "__j", "__local", "__carry", *odd)


def progress(status: DataFrame) -> DataFrame:
    """ETA, epoch and share done from step, start_step, max_steps, elapsed_s, batch_size and num_items."""
    done = F.greatest(F.col("step") - F.col("start_step"), F.lit(1))
    left = F.greatest(F.col("max_steps") - F.col("step"), F.lit(0))
    return (
        status.withColumn("eta_s", F.round(F.col("elapsed_s") / done * left, 1))
        .withColumn("epoch", F.round(F.col("step") * F.col("batch_size") / F.col("num_items"), 2))
        .withColumn("done", F.round(F.col("step") / F.col("max_steps"), 4))
    )


def loss_alarms(metrics: DataFrame, loss: str = "loss") -> DataFrame:
    """Rows whose loss is NaN or infinite."""
    x = F.col(loss)
    return metrics.where(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def error_kind(text: Column) -> Column:
    """Class of a failure from its log text; the first matching rule wins."""
    t = F.lower(text)
    has = lambda *words: [t.contains(w) for w in words]
    any_of = lambda tests: __import__("functools").reduce(lambda a, b: a | b, tests)
    return (
        F.when(any_of(has("out of memory", "outofmemoryerror")), F.lit("oom"))
        .when(any_of(has("gatedrepoerror", "401 client error", "403 client error")) | (t.contains("access to model") & t.contains("restricted")), F.lit("auth"))
        .when(t.contains("no space left on device"), F.lit("disk"))
        .when(t.contains("nan") & t.contains("loss"), F.lit("nan"))
        .when(t.contains("no usable samples"), F.lit("data"))
        .when(t.contains("connection") & any_of(has("huggingface", "hf.co")), F.lit("network"))
        .when(t.contains("bitsandbytes"), F.lit("deps"))
        .otherwise(F.lit("error"))
    )


def classify_errors(logs: DataFrame, text: str) -> DataFrame:
    """Add error_kind and hint."""
    hint = F.lit(None).cast("string")
    for kind, advice in ERROR_CLASSES:
        hint = F.when(F.col("error_kind") == kind, F.lit(advice)).otherwise(hint)
    return logs.withColumn("error_kind", error_kind(F.col(text))).withColumn("hint", hint)


def stale_jobs(status: DataFrame, now: Column, timeout_s: int, time: str = "time") -> DataFrame:
    """Jobs that are not finished and went silent: crashed, or cancelled if they never started as part of a chain."""
    silent = now.cast("double") - F.col(time).cast("double") > timeout_s
    started = F.col("state").isNotNull() & (F.col("state") != "queued")
    final = F.coalesce(F.col("state").isin(*TERMINAL), F.lit(False))
    state = F.when(started, F.lit("crashed")).when(F.col("chain_id").isNotNull(), F.lit("cancelled")).otherwise(F.lit("crashed"))
    return status.withColumn("state", F.when(~final & silent, state).otherwise(F.col("state")))


def stage_roots(jobs: DataFrame, job: str = "job_id", parent: str = "init_from", max_rounds: int = 40) -> DataFrame:
    """(job, root, depth) of every job by pointer doubling: log2(longest chain) joins.

    Every round is written to the shared folder, so lineage stays short and survives lost
    executors. A missing parent ends the chain; a cycle raises.
    """
    known = jobs.select(F.col(job).alias("__known"))
    linked = jobs.select(job, F.col(parent).alias("up")).join(known, F.col("up") == F.col("__known"), "left")
    state = materialize(
        linked.select(
            job, F.col("__known").alias("up"), F.coalesce("__known", F.col(job)).alias("root"),
            F.when(F.col("__known").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"),
        ),
        "stage-roots",
    )
    done = state.where(F.col("up").isNull()).select(job, "root", "depth")
    for _ in range(max_rounds):
        going = state.where(F.col("up").isNotNull())
        if not going.limit(1).count():
            return done
        jump = state.select(F.col(job).alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("d2"))
        ended = done.select(F.col(job).alias("up"), F.lit(None).cast(jobs.schema[job].dataType).alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("d2"))
        both = jump.where(F.col("up2").isNotNull()).unionByName(ended)
        state = materialize(
            going.join(both, "up").select(job, F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth")),
            "stage-roots",
        )
        done = done.unionByName(state.where(F.col("up").isNull()).select(job, "root", "depth"))
    raise ValueError("the stage chain has a cycle")


def stage_chain(jobs: DataFrame, job_id, job: str = "job_id", parent: str = "init_from", max_rounds: int = 40) -> DataFrame:
    """The stages that lead to one job, oldest first (stage 1 = root).

    Round k knows the stages up to 2^k - 1 steps back and a link of 2^k steps for every job, so a
    chain of any length takes log2 of it in rounds, each a written table. A cycle raises.
    """
    known = jobs.select(F.col(job).alias("__known"))
    links = jobs.select(job, F.col(parent).alias("up")).join(known, F.col("up") == F.col("__known")).select(job, "up")
    chain = jobs.where(F.col(job) == F.lit(job_id)).select(job, F.lit(0).cast("long").alias("back"))
    for k in range(max_rounds):
        links, chain = materialize(links, "stage-links"), materialize(chain, "stage-chain")
        more = chain.join(links, job).select(F.col("up").alias(job), (F.col("back") + 2**k).alias("back"))
        if not more.limit(1).count():
            oldest = chain.agg(F.max("back")).scalar()
            return chain.select(job, (oldest - F.col("back") + 1).alias("stage"))
        chain = chain.unionByName(more)
        further = links.select(F.col(job).alias("up"), F.col("up").alias("up2"))
        links = links.join(further, "up").select(job, F.col("up2").alias("up"))
    raise ValueError("the stage chain has a cycle")


def stage_results(roots: DataFrame, results: DataFrame, job: str = "job_id") -> DataFrame:
    """Stage number and result texts of every job."""
    part = lambda c, label: F.when(F.col(c).isNotNull(), F.format_string(f"{label} %.3f", F.col(c)))
    bits = F.concat_ws(", ", part("train_loss", "train loss"), part("eval_loss", "eval loss"), part("accuracy", "pref. accuracy"))
    return roots.join(results, job, "left").select(
        job, "root", (F.col("depth") + 1).alias("stage"), F.when(bits == "", F.lit("-")).otherwise(bits).alias("result")
    )
