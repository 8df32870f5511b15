"""Incremental import: new files are validated, de-duplicated and appended as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from trainset.operators.clean import length_reason
from trainset.operators.normalize import normalize_columns
from trainset.operators.traces import text_fingerprint
from trainset.session import scratch_path


def import_stream(rows: DataFrame, time: str, horizon: str = "7 days", min_chars: int = 1, max_chars: int | None = None) -> DataFrame:
    """Text rows (text, …, ingest time) to kept records.

    Copies are dropped while their first appearance is within ``horizon`` of the watermark;
    that bounds the state, and a copy beyond it reappears. ``History`` never forgets.
    """
    return checked_rows(rows, min_chars, max_chars).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["fp"])


def checked_rows(rows: DataFrame, min_chars: int = 1, max_chars: int | None = None) -> DataFrame:
    """Valid text rows of allowed length, with ``chars`` and the fingerprint ``fp``."""
    checked = normalize_columns(rows.withColumn("kind", F.lit("text"))).where("valid").drop("issues", "first_error", "valid")
    sized = checked.withColumn("chars", F.length("text").cast("long"))
    return sized.where(length_reason(F.col("chars"), min_chars, max_chars).isNull()).withColumn("fp", text_fingerprint(F.col("text")))


@dataclass(frozen=True)
class History:
    """Everything that was ever imported under ``path``: records by batch, and their fingerprints in ``buckets`` by hash.

    A batch is shuffled once to meet the fingerprints, which lie in the same buckets on disk and are never shuffled, however
    many there are. Batches have numbers; a batch that is repeated, after a failure or by mistake, replaces what it wrote, so
    it adds nothing twice.
    """

    path: str
    buckets: int = 64

    @property
    def _name(self) -> str:
        return f"history_{abs(hash((self.path, self.buckets))):x}"

    def fingerprints(self, spark: SparkSession) -> DataFrame:
        """(fp, batch); the table is known to the session by its folder alone, so any session may go on."""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name} (fp STRING, batch BIGINT) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/fingerprints'"
        )
        spark.catalog.refreshTable(self._name)
        return spark.table(self._name)

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/records")

    def unseen(self, rows: DataFrame, batch: int, seq: str) -> DataFrame:
        """The first row, by ``seq``, of each fingerprint ``fp`` that no other batch has brought."""
        seen = self.fingerprints(rows.sparkSession).where(F.col("batch") != batch).select("fp")
        firsts = rows.groupBy("fp").agg(F.min(seq).alias(seq)).join(seen, "fp", "left_anti")
        return rows.join(firsts, [seq, "fp"], "left_semi")

    def add(self, rows: DataFrame, batch: int, seq: str) -> DataFrame:
        """Import a batch of checked rows (see ``checked_rows``) with unique ``seq``; returns the rows that are kept."""
        spark = rows.sparkSession
        made = self.unseen(rows, batch, seq).withColumn("batch", F.lit(batch).cast("long"))
        if not made.columns or made.isEmpty():
            # A batch without new rows replaces what an earlier attempt of it has left.
            self._forget(spark, batch)
            return made
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/records")
        kept = self.records(spark).where(F.col("batch") == batch)
        brought = kept.select("fp").repartition(self.buckets, "fp")
        spark.sql(f"INSERT OVERWRITE TABLE {self._name} PARTITION (batch = {int(batch)}) SELECT fp FROM {{brought}}", brought=brought)
        return kept

    def _forget(self, spark: SparkSession, batch: int) -> None:
        if self.fingerprints(spark).where(F.col("batch") == batch).isEmpty():
            return
        raise ValueError(f"batch {batch} brought rows before and none now; it is not the same batch")

    def sink(self, seq: str, min_chars: int = 1, max_chars: int | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: the stream's batch numbers make a restart harmless."""
        return lambda rows, batch: None if self.add(checked_rows(rows, min_chars, max_chars), batch, seq) is not None else None


def run_to_files(
    stream: DataFrame, spark: SparkSession, label: str, mode: str = "append", target: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Process what is there, append it as Parquet with a checkpoint, and read the result.

    With the same ``target`` and ``checkpoint`` a later run takes only what is new and adds to the
    earlier result; without them the run stands alone in a folder of its own.
    """
    if (target is None) != (checkpoint is None):
        raise ValueError("target and checkpoint belong together")
    out, state = target or scratch_path(spark, label), checkpoint or scratch_path(spark, f"{label}-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        # Update and complete results are not append-only: every micro-batch is its own table.
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
