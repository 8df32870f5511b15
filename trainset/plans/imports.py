"""Importing a table: convert, validate, filter, de-duplicate, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trainset.operators.clean import length_reason, mark_duplicates
from trainset.operators.convert import convert_table
from trainset.operators.mapping import Mapping, detect_mapping
from trainset.operators.normalize import normalize_json
from trainset.operators.sampling import sample_rows
from trainset.operators.traces import drop_reasoning, fingerprint, record_chars


def import_reasons(records: DataFrame, min_chars: int = 1, max_chars: int | None = None, dedupe: bool = True) -> DataFrame:
    """Add ``reason`` (NULL = kept) to validated records with first_error, chars and fp."""
    early = F.coalesce(F.col("first_error"), length_reason(F.col("chars"), min_chars, max_chars))
    marked = records.withColumn("reason", early)
    return mark_duplicates(marked) if dedupe else marked


def import_table(
    df: DataFrame,
    mapping: Mapping | None = None,
    *,
    seq: str = "seq",
    max_rows: int | None = None,
    min_chars: int = 1,
    max_chars: int | None = None,
    dedupe: bool = True,
    keep_reasoning: bool = True,
    source: str | None = None,
    license: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """One lazy plan from source rows to judged records (``reason`` NULL = kept).

    Everything is imported, unless ``max_rows`` asks for a seeded sample. Shuffles: the minimum per
    fingerprint, and the join of the records with the first copies on ``seq``.
    """
    if mapping is None:
        mapping, why = detect_mapping(df)
        if mapping is None:
            raise ValueError(f"no mapping given and none fits the columns: {why}")
    meta = {k: v for k, v in (("source", source), ("license", license)) if v}
    rows = sample_rows(df, max_rows, seed, [seq])
    records = convert_table(rows, mapping, seq, meta)
    if "messages" in records.columns and not keep_reasoning:
        records = records.withColumn("messages", drop_reasoning(F.col("messages")))
    for name, kind in (("messages", None), ("text", "string"), ("prompt", "string"), ("completion", "string"),
                       ("image", "string"), ("caption", "string"), ("captions", "array<string>"),
                       ("references", "array<string>"), ("chosen", None), ("rejected", None)):
        if name not in records.columns:
            from trainset.schema import MESSAGE

            records = records.withColumn(name, F.lit(None).cast(kind or f"array<{MESSAGE.simpleString()}>"))
    measured = records.withColumn("chars", record_chars()).withColumn("fp", fingerprint())
    return import_reasons(measured, min_chars, max_chars, dedupe)


def add_examples(raw: DataFrame, source: str = "handwritten", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """``(records, problems)`` of hand-written JSON records in a ``raw`` VARIANT column.

    Good records are tagged with their source and ready to append; problems list the errors by
    ``seq``. Append the records with ``sources.files.append_jsonl`` or a Parquet append.
    """
    judged = normalize_json(raw)
    tagged = judged.where("valid").withColumn("meta_source", F.lit(source)).drop("valid", "first_error", "issues")
    errors = F.filter("issues", lambda i: i["level"] == "error")
    problems = judged.where(~F.col("valid")).select(
        seq, F.array_join(F.transform(errors, lambda i: F.concat_ws(": ", i["code"], i["message"])), "; ").alias("problem")
    )
    return tagged, problems
