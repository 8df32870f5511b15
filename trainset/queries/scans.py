"""Sources, sinks, sampling at the source, profiles and manifests."""

import pyarrow as pa

from trainset.operators.mapping import Mapping
from trainset.plans.imports import import_reasons
from trainset.queries.cleaning import _IMPORTED
from trainset.queries.common import SEED_SQL, F, long, query, table, text_records
from trainset.queries.profiling import DOC_STATS, pct_sql, text_summary
from trainset.session import materialize, scratch_path
from trainset.sources import files
from trainset.sources.profile import append_manifest, load_manifest, manifest_row, profile_columns, with_statistics


@query("scan_with_limit", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def scan_with_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(100)


@query(
    "jsonl_round_trip",
    """SELECT source, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars, min(doc_id) AS first_id
       FROM documents GROUP BY source""",
)
def jsonl_round_trip(spark, sf_dir):
    path = scratch_path(spark, "documents-jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path, gzip=True)
    raw = F.col("raw")
    rows = files.read_objects(spark, path).select(
        F.variant_get(raw, "$.source", "string").alias("source"),
        F.variant_get(raw, "$.text", "string").alias("text"),
        F.variant_get(raw, "$.doc_id", "long").alias("doc_id"),
    )
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("first_id")
    )


@query("jsonl_append", "SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark) AS lines")
def jsonl_append(spark, sf_dir):
    path = scratch_path(spark, "appended-jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents").select("text"), path)
    files.append_jsonl(table(spark, sf_dir, "benchmark").select("text"), path)
    return files.count_lines(spark, path)


@query(
    "jsonl_line_numbers",
    "SELECT count(*) AS lines, CAST(max(r) AS BIGINT) AS last_line, CAST(sum(r) AS BIGINT) AS line_sum FROM (SELECT row_number() OVER () AS r FROM benchmark)",
)
def jsonl_line_numbers(spark, sf_dir):
    path = scratch_path(spark, "numbered-jsonl")
    files.write_jsonl(table(spark, sf_dir, "benchmark").coalesce(1), path)
    return files.read_raw_jsonl(spark, path).agg(
        F.count(F.lit(1)).alias("lines"), F.max("line").alias("last_line"), F.sum("line").alias("line_sum")
    )


@query(
    "json_array_split",
    """SELECT source, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(doc_id % 1000) AS BIGINT) AS ids,
       count(DISTINCT md5(text)) AS texts FROM documents GROUP BY source""",
)
def json_array_split(spark, sf_dir):
    """Whole documents as ``.json`` arrays, one for each written file, cut into elements by many tasks."""
    path = scratch_path(spark, "documents-json")
    rows = F.to_json(F.struct("doc_id", "text", "source"))
    lines = table(spark, sf_dir, "documents").select(F.concat(rows, F.lit(",")).alias("value"))
    # A text file of lines becomes an array by the way it is written: "[" before, an empty object behind.
    lines.mapInArrow(_as_array, "value string").write.text(path)
    raw = F.col("raw")
    back = files.read_json_array(spark, path).select(
        F.variant_get(raw, "$.source", "string").alias("source"),
        F.variant_get(raw, "$.text", "string").alias("text"),
        F.variant_get(raw, "$.doc_id", "long").alias("doc_id"),
    ).where("doc_id IS NOT NULL")
    return back.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).alias("chars"), F.sum(F.col("doc_id") % 1000).alias("ids"),
        F.count_distinct(F.md5("text")).alias("texts"),
    )


def _as_array(batches):
    """The lines of a partition between the brackets of an array."""
    yield pa.record_batch({"value": ["["]})
    yield from batches
    yield pa.record_batch({"value": ["{}]"]})


@query(
    "delimited_round_trip",
    """SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, max(c_name) AS last_name
       FROM customer GROUP BY 1""",
)
def delimited_round_trip(spark, sf_dir):
    path = scratch_path(spark, "customer-tsv")
    table(spark, sf_dir, "customer").write.csv(path, header=True, sep="\t", quote='"', escape='"')
    rows = files.read_delimited(spark, path, "\t")
    return rows.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(rows.c_custkey.cast("long")).alias("keys"), F.max("c_name").alias("last_name")
    )


@query("text_source_rows", "SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def text_source_rows(spark, sf_dir):
    """Documents written as plain text with an escape for line breaks, read back as a text source."""
    path = scratch_path(spark, "documents-txt")
    docs = table(spark, sf_dir, "documents")
    escaped = F.regexp_replace(F.regexp_replace("text", r"\\", r"\\\\"), "\r", r"\\r")
    docs.select(F.regexp_replace(escaped, "\n", r"\\n").alias("value")).write.text(path)
    lines = spark.read.text(path)
    back = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\\\\", "\u0001"), r"\\[nr]", "x"), "\u0001", "x")
    return lines.agg(F.count(F.lit(1)).alias("files"), F.sum(F.length(back)).alias("chars"))


@query(
    "seeded_source_sample",
    f"SELECT doc_id, source FROM documents ORDER BY {SEED_SQL(42, 'doc_id')}, doc_id LIMIT 200",
)
def seeded_source_sample(spark, sf_dir):
    return files.read_source(spark, f"{sf_dir}/documents.parquet", max_rows=200, key="doc_id").select("doc_id", "source")


_COLUMNS = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string"))


@query(
    "profile_source",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS \"type\", count(*) AS \"rows\", count(*) - count({c}) AS nulls FROM orders" for c, t in _COLUMNS
    ),
)
def profile_source(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    kinds = F.when(F.col("type").startswith("timestamp"), F.lit("timestamp")).otherwise(F.col("type"))
    return profile_columns(df).withColumn("type", kinds)


@query(
    "import_manifest",
    _IMPORTED + """, r AS (SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL GROUP BY 1)
    SELECT 'documents' AS name, 'local:documents.parquet' AS source, 'unknown' AS license,
      '{"layout": "text", "text": "text"}' AS mapping, 'explicit mapping' AS mapping_explanation,
      count(*) AS "read", count(*) FILTER (reason IS NULL) AS records,
      CAST(sum(chars) FILTER (reason IS NULL) AS BIGINT) AS chars,
      (SELECT '{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}' FROM r) AS rejected FROM marked""",
)
def import_manifest(spark, sf_dir):
    judged = import_reasons(text_records(spark, sf_dir), min_chars=50, max_chars=20000)
    mapping = Mapping(layout="text", text="text")
    return manifest_row(judged, "documents", "local:documents.parquet", "unknown", mapping)


_TOP_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS field, {c} AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rk FROM kept WHERE {c} <> '' GROUP BY {c}" for c in ("lang", "source")
)


@query(
    "import_manifest_statistics",
    _IMPORTED.replace("source, text", "source, lang, text") + ", kept AS (SELECT * FROM marked WHERE reason IS NULL), p AS (" + pct_sql("chars", "SELECT chars FROM kept") + f"), t AS ({_TOP_SQL}) "
    + " UNION ALL ".join(f"SELECT 'stats' AS part, '{k}' AS name, CAST(max(v) AS DOUBLE) AS value FROM (SELECT {v} AS v FROM kept)" for k, v in DOC_STATS.items())
    + "".join(f" UNION ALL SELECT 'stats', 'chars_{a}', CAST({a} AS DOUBLE) FROM p" for a in ("min", "p50", "p90", "p99", "max"))
    + " UNION ALL SELECT field, name, CAST(n AS DOUBLE) FROM t WHERE rk <= 5 UNION ALL SELECT 'counts', 'records', count(*) FROM kept",
)
def import_manifest_statistics(spark, sf_dir):
    """Statistics of an import as its manifest holds them, written twice and loaded again."""
    judged = import_reasons(text_records(spark, sf_dir), min_chars=50, max_chars=20000)
    judged = materialize(text_summary(judged, "lang", "source", "reason"), "judged")  # narrow: several reports read it
    row = manifest_row(judged, "documents", "local:documents.parquet", "unknown", Mapping(layout="text", text="text"))
    row = materialize(with_statistics(row, judged.where("reason IS NULL"), ("lang", "source")), "manifest")
    path = scratch_path(spark, "manifests")
    for _ in range(2):  # an append that is tried again
        append_manifest(row, path)
    loaded = load_manifest(spark, path, "documents")
    stats = loaded.select(F.lit("stats").alias("part"), F.explode("stats").alias("name", "value"))
    common = loaded.select(F.inline("common")).select(F.col("field").alias("part"), F.col("value").alias("name"), F.col("n").cast("double").alias("value"))
    counts = loaded.select(F.lit("counts").alias("part"), F.lit("records").alias("name"), F.col("records").cast("double").alias("value"))
    return stats.unionByName(common).unionByName(counts)
