"""What a source table looks like, and the manifest of an import."""

from __future__ import annotations

import json

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from trainset.functions.text import shorten_counted
from trainset.operators.mapping import CAPTION_COLUMNS, Mapping, detect_mapping
from trainset.operators.stats import dataset_stats, top_values

SHOW_CHARS, SHOW_ITEMS, SHOW_ROWS = 300, 6, 3


def short_value(df: DataFrame, name: str):
    """A readable, shortened form of one column."""
    dtype, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(dtype, T.BinaryType):
        return F.lit("<binary>")
    if isinstance(dtype, T.ArrayType):
        return shorten_counted(F.to_json(F.slice(c, 1, SHOW_ITEMS)), SHOW_CHARS)
    if isinstance(dtype, (T.StructType, T.MapType, T.VariantType)):
        return shorten_counted(F.to_json(c), SHOW_CHARS)
    return shorten_counted(c.cast("string"), SHOW_CHARS)


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls): one aggregate over the table, unpivoted."""
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(df.columns)])
    items = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.col("__rows").alias("rows"), (F.col("__rows") - F.col(f"n_{i}")).alias("nulls"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return row.select(F.inline(F.array(*items)))


def first_rows(df: DataFrame, order: str, n: int = SHOW_ROWS) -> DataFrame:
    top = df.orderBy(order).limit(n)
    return top.select(*[short_value(df, c).alias(c) for c in df.columns])


def suggest(df: DataFrame) -> dict:
    """Image and caption columns, or a text mapping, whichever the schema offers."""
    binary = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.BinaryType)
        or (isinstance(f.dataType, T.StructType) and {"bytes", "path"} <= set(f.dataType.names))
    ]
    if binary:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        caption = next((t for t in texts if t.lower() in CAPTION_COLUMNS), texts[0] if texts else None)
        return {"kind": "image", "image_column": binary[0], "caption_column": caption}
    mapping, why = detect_mapping(df)
    return {"kind": "text", "mapping": mapping.to_dict() if mapping else None, "explanation": why}


def manifest_row(
    judged: DataFrame, name: str, source: str, license: str | None, mapping: Mapping, explanation: str = "explicit mapping"
) -> DataFrame:
    """One row that describes an import: origin, mapping, how many read, kept and rejected."""
    reasons = (
        judged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("rejected"))
    )  # one entry per reason code: a short, fixed vocabulary
    totals = judged.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(F.col("reason").isNull()).alias("records"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("chars"))), F.lit(0)).alias("chars"),
    )
    return totals.select(
        F.lit(name).alias("name"), F.lit(source).alias("source"), F.lit(license).cast("string").alias("license"),
        F.lit(json.dumps(mapping.to_dict(), sort_keys=True)).alias("mapping"), F.lit(explanation).alias("mapping_explanation"),
        "read", "records", "chars", reasons.scalar().alias("rejected"),
    )


def with_statistics(manifest: DataFrame, kept: DataFrame, common: Sequence[str] = ("meta_source", "meta_license", "meta_lang"), k: int = 5) -> DataFrame:
    """The manifest with its time (``created``), ``stats`` and ``common`` of the kept records.

    ``kept`` has the columns that ``dataset_stats`` reads, as ``record_summary`` gives them, and those named in
    ``common``. ``stats`` maps a fixed set of metrics to numbers, ``common`` lists the ``k`` most frequent values
    of each column; both are bounded, whatever was imported. Without kept records ``common`` is empty.
    """
    stats = dataset_stats(kept).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))))
    top = F.array_sort(F.collect_list(F.struct("field", (-F.col("n")).alias("least"), "value", "n")))  # the frequent first
    top = F.transform(top, lambda v: F.struct(v["field"].alias("field"), v["value"].alias("value"), v["n"].alias("n")))
    values = top_values(kept, common, k).agg(top) if common else None
    none = F.array().cast("array<struct<field:string,value:string,n:bigint>>")
    return manifest.select(
        "*", F.current_timestamp().alias("created"), stats.scalar().alias("stats"), (none if values is None else values.scalar()).alias("common")
    )


def append_manifest(manifest: DataFrame, path: str) -> None:
    """Add the manifest of an import to the table of all imports; earlier ones stay."""
    manifest.write.mode("append").parquet(path)


def load_manifest(spark, path: str, name: str) -> DataFrame:
    """The last manifest of that name, by ``created``; no row if there is none. A retried append changes nothing here."""
    return spark.read.parquet(path).where(F.col("name") == name).orderBy(F.desc("created")).limit(1)
