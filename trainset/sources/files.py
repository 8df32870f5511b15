"""Readers and writers for JSON lines, JSON documents, delimited text, Parquet and text folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trainset.functions import variants as V
from trainset.functions.text import is_blank, parse_json
from trainset.operators.normalize import ensure_valid, normalize_json
from trainset.operators.sampling import sample_rows
from trainset.session import materialize
from trainset.sources.split import are_arrays, array_elements, json_pieces

TEXT_GLOB = "*.{txt,md,TXT,MD}"


def read_raw_jsonl(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """JSON lines (plain or gzip): file, line, seq and the VARIANT ``raw``; NULL = not valid JSON.

    Blank lines are skipped but counted in the line numbers. Lines are numbered per split
    (a split is contiguous in its file and never larger than maxPartitionBytes), and the
    numbered table is written once, so every later branch sees the same numbers. ``seq`` counts the
    lines of all files, in the order of their paths.
    ``numbered=False`` leaves out line and seq and streams straight through: no copy, no shuffle.
    """
    if not numbered:
        plain = spark.read.text(path).where(~is_blank(F.col("value")))
        return plain.select(F.col("_metadata.file_path").alias("file"), parse_json(F.col("value")).alias("raw"))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    stored = materialize(lines, "lines")
    blocks = stored.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row a split
    bases = blocks.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("all")
    )
    return (
        stored.join(bases, ["file", "block"])
        .where(~is_blank(F.col("value")))
        .select(
            "file",
            (F.col("base") + F.col("at") - F.col("first") + 1).alias("line"),
            (F.col("all") + F.col("at") - F.col("first")).alias("seq"),
            parse_json(F.col("value")).alias("raw"),
        )
    )


def read_records(spark: SparkSession, path: str, mode: str = "skip", limit: int | None = None) -> DataFrame:
    """Canonical records of a JSON lines file; ``mode="failfast"`` raises on the first report of errors."""
    records = normalize_json(read_raw_jsonl(spark, path))
    if mode == "failfast":
        ensure_valid(records)
    valid = records.where("valid").drop("valid", "first_error")
    return valid.orderBy("seq").limit(limit) if limit is not None else valid


def read_objects(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Generic JSON lines source: objects only, other JSON values are ignored."""
    return read_raw_jsonl(spark, path, numbered).where(V.is_object(F.col("raw")))


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ``.json`` file: its array, its first list-valued key, or the object itself.

    A document that is not an array is one value, so its file is one row until it is exploded;
    :func:`read_json_array` reads arrays in parallel.
    """
    doc = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), parse_json(F.col("value")).alias("v"), F.json_object_keys("value").alias("keys")
    )
    # Keys may hold any character, so they are matched as values and never pasted into a path.
    listed = doc.where(V.is_object(F.col("v"))).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("at", "key", "member"))
    first = listed.where(V.is_array(F.col("member"))).groupBy(F.col("file").alias("__file")).agg(
        F.min(F.array_position("keys", F.col("key"))).alias("place"))
    members = listed.join(first, (F.col("file") == F.col("__file")) & (F.array_position("keys", F.col("key")) == F.col("place")))
    lists = members.select("file", F.posexplode(V.items(F.col("member"))).alias("pos", "raw"))
    whole = doc.join(first, F.col("file") == F.col("__file"), "left_anti")
    rows = F.when(V.is_array(F.col("v")), V.items(F.col("v"))).when(V.is_object(F.col("v")), F.array("v"))
    return whole.select("file", F.posexplode(rows).alias("pos", "raw")).unionByName(lists).where(V.is_object(F.col("raw")))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Objects of ``.json`` files that hold one array each, however large: file, record, pos, raw.

    The files are split like text and copied once; a task holds one element at a time. Files of
    another form go through :func:`read_json_document`, all in record 0.
    """
    pieces = json_pieces(spark, path)
    if not are_arrays(pieces):
        return read_json_document(spark, path).select("file", F.lit(0).cast("long").alias("record"), "pos", "raw")
    return array_elements(pieces).where(V.is_object(F.col("raw")))


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; every column is a string."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', inferSchema=False)


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``.txt``/``.md`` file below a folder: text, file name, path."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", TEXT_GLOB)
        .text(path, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))
    )


def read_source(
    spark: SparkSession, path: str, max_rows: int | None = None, seed: int = 42, key: str | None = None
) -> DataFrame:
    """Pick the reader by file name; optionally a seeded sample of ``max_rows`` rows."""
    name = path.rstrip("/").lower()
    if name.endswith((".jsonl", ".jsonl.gz", ".ndjson")):
        # Only a sample needs an address per line.
        rows, order = read_objects(spark, path, numbered=max_rows is not None), ["file", "line"]
    elif name.endswith(".json"):
        rows, order = read_json_array(spark, path), ["file", "record", "pos"]
    elif name.endswith(".csv"):
        rows, order = read_delimited(spark, path), None
    elif name.endswith(".tsv"):
        rows, order = read_delimited(spark, path, "\t"), None
    elif name.endswith(".parquet"):
        rows, order = spark.read.parquet(path), None
    elif name.endswith((".txt", ".md")) or "." not in name.rsplit("/", 1)[-1]:
        rows, order = read_text_folder(spark, path), ["path"]
    else:
        raise ValueError(f"unsupported file type: {path}")
    if max_rows is None:
        return rows
    chosen = [key] if key else order
    if chosen is None:
        # Delimited and Parquet rows have no address of their own: their content is the key.
        rows = rows.withColumn("__key", F.to_json(F.struct(*rows.columns)))
        return sample_rows(rows, max_rows, seed, ["__key"]).drop("__key")
    return sample_rows(rows, max_rows, seed, chosen)


def record_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON line per row; NULL fields are left out."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, mode: str = "error") -> None:
    """Write rows as JSON lines; the output committer makes the result appear at once.

    ``mode="append"`` adds a finished batch to an existing folder.
    """
    options = {"compression": "gzip"} if gzip else {}
    record_json(df).write.mode(mode).options(**options).text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, mode="append")


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Number of non-blank lines, as a one-row table."""
    return spark.read.text(path).where(~is_blank(F.col("value"))).agg(F.count(F.lit(1)).alias("lines"))
