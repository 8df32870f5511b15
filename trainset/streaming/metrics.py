"""Metrics logs as streams: latest status, smoothed loss, silent jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trainset.operators.runs import SMOOTHING

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssZ"  # fixed value: how the log writes its times
METRICS = T.StructType(
    [
        T.StructField("job_id", T.StringType()), T.StructField("time", T.StringType()), T.StructField("step", T.LongType()),
        T.StructField("loss", T.DoubleType()), T.StructField("eval_loss", T.DoubleType()), T.StructField("learning_rate", T.DoubleType()),
    ]
)


def read_metrics(spark: SparkSession, path: str, late: str = "1 hour", max_files: int | None = None) -> DataFrame:
    """An append-only folder of JSON metric lines as a stream with event time."""
    reader = spark.readStream.schema(METRICS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).withColumn("time", F.to_timestamp("time", TIME_FORMAT)).withWatermark("time", late)


def latest_status_stream(metrics: DataFrame, job: str = "job_id", time: str = "time") -> DataFrame:
    """Running last row per job (update or complete output mode)."""
    rest = [c for c in metrics.columns if c != job]
    return metrics.groupBy(job).agg(F.max_by(F.struct(*rest), F.struct(time, "step")).alias("s")).select(job, "s.*")


def ema_stream(metrics: DataFrame, job: str = "job_id") -> DataFrame:
    """Smoothed loss after every micro-batch: (job, step, smoothed). State: one number per job.

    Rows are ordered by step inside a micro-batch; bound its size with maxFilesPerTrigger. Rows
    without a loss are left out; a NaN stays.
    """

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("step")
        value = state.get[0] if state.exists else None
        for x in rows["loss"]:
            value = float(x) if value is None else SMOOTHING * value + (1 - SMOOTHING) * float(x)
        state.update((value,))
        yield pd.DataFrame({job: [key[0]], "step": [int(rows["step"].iloc[-1])], "smoothed": [value]})

    kind = metrics.schema[job].dataType.simpleString()
    return metrics.where(F.col("loss").isNotNull()).select(job, "step", "loss").groupBy(job).applyInPandasWithState(
        update, f"{job} {kind}, step long, smoothed double", "value double", "update", GroupStateTimeout.NoTimeout
    )


def stale_jobs_stream(metrics: DataFrame, timeout_ms: int, job: str = "job_id") -> DataFrame:
    """Emit (job, last_time, state='crashed') once a job has been silent for ``timeout_ms`` of event time."""

    def watch(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({job: [key[0]], "last_time_ms": [last], "state": ["crashed"]})
            return
        newest = max(int(f["ms"].max()) for f in frames)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + timeout_ms, state.getCurrentWatermarkMs() + 1))

    rows = metrics.select(job, "time", F.unix_millis("time").alias("ms"))
    kind = metrics.schema[job].dataType.simpleString()
    return rows.groupBy(job).applyInPandasWithState(
        watch, f"{job} {kind}, last_time_ms long, state string", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )
