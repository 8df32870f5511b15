"""Large ``.json`` arrays, read by many tasks.

Where an element starts depends on every quote and bracket before it. Each piece of the file is therefore
summed up for both cases, starting outside and inside a string; running totals over the blocks of the file
settle the case, then the depth, and then the number of the element a piece belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trainset.functions import variants as V
from trainset.functions.text import parse_json
from trainset.operators.ordered import with_running_total
from trainset.session import materialize

_CLOSE = "}"


def _depth(text: Column) -> Column:
    """Opening less closing brackets outside of strings, for text that starts outside of one."""
    bare = F.regexp_replace(text, '"[^"]*+("|$)', "")
    opened = F.length(F.regexp_replace(bare, r"[^\[{]", ""))
    return (opened - F.length(F.regexp_replace(bare, r"[^\]}]", ""))).cast("int")


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text of JSON files cut behind every ``}``, with quotes and depth changes; written once.

    The cut is made by Spark's own text reader, so a file splits like any text. JSON knows no escape of
    ``}``: no piece starts behind a lone backslash.
    """
    text = spark.read.option("lineSep", _CLOSE).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    return materialize(
        text.withColumns({"quotes": quotes, "outside": _depth(plain), "inside": _depth(F.concat(F.lit('"'), plain))}), "json-pieces"
    )


def are_arrays(pieces: DataFrame) -> bool:
    """Whether every file starts with a bracket."""
    first = pieces.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("value"))
    return first.agg(F.bool_and(F.ltrim(F.regexp_replace("value", r"^\x{FEFF}?\s*", "")).startswith("["))).first()[0] is True


def array_elements(pieces: DataFrame) -> DataFrame:
    """(file, record, pos, raw) of files that hold one array each, in order of (record, pos).

    A record is an object of the array with the elements that are not objects before it; ``raw`` is a
    VARIANT, or NULL for a record that is not valid JSON. No group holds more than one record.
    """
    narrow = pieces.drop("value")
    block = F.col("block")
    quoted = with_running_total(narrow, ["at"], block, "before", F.col("quotes"), by=["file"])
    even = F.col("before") % 2 == 0
    settled = quoted.select(
        "file", "block", "at",
        (F.when(even, F.col("outside")).otherwise(F.col("inside"))
         - F.when((F.col("before") + F.col("quotes")) % 2 == 0, F.lit(1)).otherwise(F.lit(0))).alias("change"),
        ((F.col("before") + F.col("quotes")) % 2 == 0).alias("open_air"),
    )
    deep = with_running_total(settled, ["at"], block, "depth", F.col("change"), by=["file"])
    ends = (F.col("open_air") & (F.col("depth") + F.col("change") == 1)).cast("int")
    numbered = with_running_total(deep.withColumn("ends", ends), ["at"], block, "record", F.col("ends"), by=["file"])
    parts = pieces.select("file", "block", "at", "value").join(numbered.select("file", "block", "at", "record", "ends"), ["file", "block", "at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"]), _CLOSE)
    records = parts.groupBy("file", "record").agg(text.alias("text"), F.max("ends").alias("ended"))
    head = F.when(F.col("record") == 0, F.regexp_replace("text", r"^\x{FEFF}?\s*\[", "")).otherwise(F.regexp_replace("text", r"^\s*,", ""))
    # The last piece of a file has no brace behind it, but the bracket that ends the array.
    body = F.when(F.col("ended") == 1, F.concat(F.col("head"), F.lit(_CLOSE))).otherwise(F.regexp_replace("head", r"\]\s*$", ""))
    lists = records.withColumn("head", head).select("file", "record", body.alias("body")).where(F.trim(F.regexp_replace("body", r"\s+", "")) != "")
    whole = parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    return lists.select("file", "record", F.posexplode_outer(V.items(whole)).alias("pos", "raw"))
