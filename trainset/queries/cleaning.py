"""Filters, cleaning, exact de-duplication and import reports."""

from trainset.functions.text import is_blank, shorten
from trainset.operators import clean as C
from trainset.operators.traces import turn_fingerprints, turn_summary
from trainset.plans.imports import import_reasons
from trainset.queries.common import WS, DataFrame, F, SparkSession, query, table, text_records

_IMPORTED = f"""
WITH d AS (
  SELECT doc_id AS seq, source, text, length(text) AS chars, trim(text, {WS}) AS body FROM documents),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'empty_text' WHEN chars < 50 OR chars > 20000 THEN 'length_filter' END AS early FROM d),
marked AS (
  SELECT *, CASE WHEN early IS NULL AND row_number() OVER (PARTITION BY early IS NULL, body ORDER BY seq) > 1
            THEN 'duplicate' ELSE early END AS reason FROM judged)
"""


@query(
    "import_reject_report",
    _IMPORTED + """
SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS records, CAST(sum(chars) AS BIGINT) AS chars
FROM marked GROUP BY 1, 2""",
)
def import_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = import_reasons(text_records(spark, sf_dir), min_chars=50, max_chars=20000)
    return marked.groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("chars").alias("chars")
    )


@query(
    "length_filter",
    "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) BETWEEN 200 AND 4000",
)
def length_filter(spark, sf_dir):
    docs = text_records(spark, sf_dir)
    return docs.where(C.length_reason(F.col("chars"), 200, 4000).isNull()).select(F.col("seq").alias("doc_id"), "chars")


@query(
    "fingerprint_group_sizes",
    f"""SELECT copies, count(*) AS groups FROM
        (SELECT count(*) AS copies FROM documents GROUP BY trim(text, {WS})) GROUP BY copies""",
)
def fingerprint_group_sizes(spark, sf_dir):
    per_fp = text_records(spark, sf_dir).groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    return per_fp.groupBy("copies").agg(F.count(F.lit(1)).alias("groups"))


@query(
    "dedupe_exact_documents",
    f"SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY trim(text, {WS})",
)
def dedupe_exact_documents(spark, sf_dir):
    return C.dedupe_exact(text_records(spark, sf_dir)).select(F.col("seq").alias("doc_id"), "source")


@query(
    "dedupe_conversations",
    f"""WITH c AS (SELECT conv_id, string_agg(role || chr(30) || trim(text, {WS}), chr(31) ORDER BY turn) AS body
        FROM conversations GROUP BY conv_id)
        SELECT min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY body""",
)
def dedupe_conversations(spark, sf_dir):
    fps = turn_fingerprints(table(spark, sf_dir, "conversations"))
    return fps.groupBy("fp").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")).drop("fp")


_PATTERN = r"(?i)licen[sc]e|password|@[a-z]+\.com"
_CLEAN = f"""
WITH d AS (SELECT doc_id AS seq, source, text, length(text) AS n, trim(text, {WS}) AS body FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos FROM d),
e AS (SELECT *, CASE WHEN pos IN (3, 7, 42) THEN 'by_position' WHEN body = '' THEN 'empty'
        WHEN n > 6000 THEN 'too_long' WHEN regexp_matches(text, '{_PATTERN}') THEN 'matched_pattern' END AS early FROM p),
marked AS (SELECT *, CASE WHEN early IS NULL AND row_number() OVER (PARTITION BY early IS NULL, body ORDER BY seq) > 1
        THEN 'duplicate' ELSE early END AS reason FROM e)
"""


def _cleaned(spark, sf_dir):
    docs = text_records(spark, sf_dir)
    ready = (
        docs.withColumn("everything", F.col("text"))
        .withColumn("all_chars", F.col("chars"))
        .withColumn("answer_chars", F.lit(0))
        .withColumn("empty", is_blank(F.col("text")))
    )
    return C.clean(ready, max_chars=6000, drop_matching=_PATTERN, drop_indices=(3, 7, 42))


@query("clean_documents_report", _CLEAN + "SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM marked GROUP BY 1, 2")
def clean_documents_report(spark, sf_dir):
    return C.reject_report(_cleaned(spark, sf_dir), ["source"])


@query(
    "clean_removed_examples",
    _CLEAN + """SELECT seq, reason, CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '…' ELSE text END AS shown
    FROM marked WHERE reason IS NOT NULL ORDER BY seq LIMIT 3""",
)
def clean_removed_examples(spark, sf_dir):
    return C.removed_examples(_cleaned(spark, sf_dir), shorten(F.col("text"), 160))


_TURNS = f"""
WITH t AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS assistant_turns,
  count(*) FILTER (role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS chars,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS answer_chars,
  coalesce(bool_or(role = 'user' AND trim(text, {WS}) = ''), false)
    OR coalesce(arg_max(trim(text, {WS}) = '', turn) FILTER (role = 'assistant'), true) AS empty
  FROM conversations GROUP BY conv_id)
"""


@query("record_lengths", _TURNS + "SELECT conv_id, turns, assistant_turns, user_turns, chars, answer_chars FROM t")
def record_lengths(spark, sf_dir):
    return turn_summary(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turns", "assistant_turns", "user_turns", "chars", "answer_chars"
    )


@query("empty_conversations", _TURNS + "SELECT conv_id, empty FROM t")
def empty_conversations(spark, sf_dir):
    return turn_summary(table(spark, sf_dir, "conversations")).select("conv_id", "empty")


@query(
    "clean_conversations_report",
    _TURNS + f""", m AS (SELECT conv_id, bool_or(regexp_matches(text, '(?i)tion')) AS hit,
      string_agg(role || chr(30) || trim(text, {WS}), chr(31) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
    e AS (SELECT t.conv_id, body, CASE WHEN empty THEN 'empty' WHEN answer_chars < 300 THEN 'short_answer'
      WHEN chars + turns - 1 > 5000 THEN 'too_long' WHEN hit THEN 'matched_pattern' END AS early FROM t JOIN m USING (conv_id)),
    r AS (SELECT CASE WHEN early IS NULL AND row_number() OVER (PARTITION BY early IS NULL, body ORDER BY conv_id) > 1
      THEN 'duplicate' ELSE early END AS reason FROM e)
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""",
)
def clean_conversations_report(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    hits = turns.groupBy("conv_id").agg(F.bool_or(F.col("text").rlike("(?i)tion")).alias("matched"))
    ready = (
        turn_summary(turns)
        .withColumn("all_chars", F.col("chars") + F.col("turns") - 1)
        .join(hits, "conv_id")
        .join(turn_fingerprints(turns), "conv_id")
    )
    return C.reject_report(
        C.clean(ready, min_answer_chars=300, max_chars=5000, drop_matching="(?i)tion", seq="conv_id")
    )


@query(
    "text_parts",
    """SELECT CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'other' END AS part, count(*) AS texts,
       CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""",
)
def text_parts(spark, sf_dir):
    part = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise(F.lit("other"))
    return table(spark, sf_dir, "conversations").groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "pattern_matches",
    f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_PATTERN}')",
)
def pattern_matches(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(C.check_pattern(_PATTERN))).select("doc_id")


@query(
    "drop_by_position",
    """WITH p AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS pos FROM (SELECT DISTINCT conv_id FROM conversations))
       SELECT conv_id, pos FROM p WHERE pos NOT IN (0, 5, 17)""",
)
def drop_by_position(spark, sf_dir):
    from trainset.operators.ordered import with_seq_position

    convs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return with_seq_position(convs, "conv_id", "pos").where(~F.col("pos").isin(0, 5, 17))
