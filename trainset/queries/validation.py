"""Record kinds, coded issues and validation reports."""

from trainset.functions.roles import canonical_role
from trainset.functions.text import split_reasoning
from trainset.operators import normalize as N
from trainset.operators.traces import turn_issues, turns_without_trailing
from trainset.queries.common import WS, F, long, query, table

_KINDS = f"""
WITH r AS (
  SELECT 'text' AS kind, doc_id AS key, CASE WHEN trim(text, {WS}) = '' THEN 'empty_text' END AS err, NULL AS warn FROM documents
  UNION ALL SELECT 'completion', item_id, CASE WHEN trim(substr(text, 151), {WS}) = '' THEN 'empty_completion' END, NULL FROM benchmark
  UNION ALL SELECT 'image', page_id, CASE WHEN trim(url, {WS}) = '' THEN 'bad_image' END,
    CASE WHEN trim(regexp_extract(html, '<title>([^<]*)</title>', 1), {WS}) = '' THEN 'empty_caption' END FROM pages)
"""


def flat_records(spark, sf_dir):
    """Documents, benchmark items and pages as one table of text, completion and image records."""
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), "text", none.alias("prompt"), none.alias("completion"), none.alias("image"), none.alias("caption")
    )
    pairs = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("seq"), none.alias("text"), F.substring("text", 1, 150).alias("prompt"),
        F.expr("substring(text, 151)").alias("completion"), none.alias("image"), none.alias("caption"),
    )
    images = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), none.alias("text"), none.alias("prompt"), none.alias("completion"), F.col("url").alias("image"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("caption"),
    )
    return N.normalize_columns(docs.unionByName(pairs).unionByName(images))


@query("record_kinds", _KINDS + "SELECT kind, count(*) AS n FROM r GROUP BY kind")
def record_kinds(spark, sf_dir):
    return flat_records(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flat_record_issues",
    _KINDS + """SELECT 'error' AS level, err AS code, count(*) AS n FROM r WHERE err IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'warning', warn, count(*) FROM r WHERE warn IS NOT NULL AND err IS NULL GROUP BY 2""",
)
def flat_record_issues(spark, sf_dir):
    return N.issue_histogram(N.issues_table(flat_records(spark, sf_dir)))


@query(
    "validation_report_flat",
    _KINDS + """SELECT unnest(['total', 'valid', 'invalid', 'traces', 'texts', 'images', 'completions']) AS metric,
      unnest([count(*), count(*) FILTER (err IS NULL), count(*) FILTER (err IS NOT NULL), 0,
      count(*) FILTER (err IS NULL AND kind = 'text'), count(*) FILTER (err IS NULL AND kind = 'image'),
      count(*) FILTER (err IS NULL AND kind = 'completion')]) AS value FROM r""",
)
def validation_report_flat(spark, sf_dir):
    return N.validation_report(flat_records(spark, sf_dir))


@query(
    "error_examples",
    f"""SELECT item_id AS seq, 'empty_completion: there is no completion' AS example FROM benchmark
        WHERE trim(substr(text, 201), {WS}) = '' ORDER BY 1 LIMIT 8""",
)
def error_examples(spark, sf_dir):
    pairs = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("seq"), F.substring("text", 1, 200).alias("prompt"), F.expr("substring(text, 201)").alias("completion")
    )
    return N.error_examples(N.normalize_columns(pairs))


@query(
    "image_captions",
    f"""WITH t AS (SELECT page_id, trim(url, {WS}) AS image, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), {WS}) AS title FROM pages)
    SELECT page_id AS seq, image, CASE WHEN title = '' THEN image ELSE title END AS caption,
      CASE WHEN title = '' THEN 1 ELSE 2 END AS variants FROM t""",
)
def image_captions(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), F.concat(F.lit(" "), F.col("url"), F.lit("\n")).alias("image"), F.lit("  ").alias("caption"),
        F.array(title, F.lit(" "), F.col("url")).alias("captions"),
    )
    return N.normalize_columns(pages).select("seq", "image", "caption", long(F.size("captions")).alias("variants"))


@query(
    "ids_and_repeats",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey > 1 THEN least(o_custkey, 100) END AS repeat FROM orders""",
)
def ids_and_repeats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_custkey").alias("repeat")
    )
    return N.normalize_columns(rows).select("id", long(F.col("repeat")).alias("repeat"))


@query(
    "canonical_roles",
    """SELECT CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' END AS canonical, count(*) AS n
       FROM conversations GROUP BY 1""",
)
def canonical_roles(spark, sf_dir):
    spoken = F.when(F.col("role") == "user", F.lit(" Human\n")).when(F.col("role") == "assistant", F.lit("GPT")).otherwise(F.lit("developer"))
    rows = table(spark, sf_dir, "conversations").select(canonical_role(spoken).alias("canonical"))
    return rows.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reasoning_split",
    f"""SELECT conv_id, turn,
        CASE WHEN turn % 3 = 2 OR (turn % 3 = 1 AND trim(left(text, 30), {WS}) = '') THEN NULL ELSE length(trim(left(text, 30), {WS})) END AS reasoning_chars,
        CASE WHEN turn % 3 = 2 THEN length(text) WHEN turn % 3 = 1 AND trim(left(text, 30), {WS}) = '' THEN length(left(text, 30)) + 8 + length(text)
          ELSE length(ltrim(text, chr(10))) END AS answer_chars
        FROM conversations""",
)
def reasoning_split(spark, sf_dir):
    """A leading block, a lone closing tag, or no reasoning at all."""
    head, k = F.substring("text", 1, 30), F.pmod("turn", F.lit(3))
    raw = (
        F.when(k == 0, F.concat(F.lit("\n<think>\n"), head, F.lit("\n</think>\n\n"), F.col("text")))
        .when(k == 1, F.concat(head, F.lit("</think>"), F.col("text")))
        .otherwise(F.col("text"))
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", split_reasoning(raw).alias("s"))
    return rows.select("conv_id", "turn", long(F.length("s.reasoning")).alias("reasoning_chars"), long(F.length("s.answer")).alias("answer_chars"))


_LAST = """
WITH l AS (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS la,
  min(turn) FILTER (role <> 'system') OVER (PARTITION BY conv_id) AS fb,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
"""


@query("drop_trailing_turns", _LAST + "SELECT conv_id, turn, role, length(text) AS chars FROM l WHERE turn <= la")
def drop_trailing_turns(spark, sf_dir):
    kept = turns_without_trailing(table(spark, sf_dir, "conversations"))
    return kept.select("conv_id", "turn", "role", long(F.length("text")).alias("chars"))


@query(
    "trace_issue_report",
    _LAST + f""", i AS (
    SELECT 'error' AS level, CASE WHEN role = 'assistant' THEN 'empty_assistant' ELSE 'empty_message' END AS code FROM l WHERE trim(text, {WS}) = ''
    UNION ALL SELECT 'warning', 'system_not_first' FROM l WHERE role = 'system' AND pos > 0
    UNION ALL SELECT 'warning', 'starts_without_user' FROM l WHERE turn = fb AND role <> 'user'
    UNION ALL SELECT 'warning', 'repeated_role' FROM l WHERE role = prev AND role IN ('user', 'assistant')
    UNION ALL SELECT 'warning', 'trailing_messages' FROM l WHERE fb IS NOT NULL AND (la IS NULL OR turn > la) AND NOT (role = 'system' AND pos = 0)
    UNION ALL SELECT 'error', 'no_messages' FROM l WHERE fb IS NULL AND pos = 0
    UNION ALL SELECT 'error', 'nothing_to_learn' FROM l WHERE fb IS NOT NULL AND la IS NULL AND pos = 0)
    SELECT level, code, count(*) AS n FROM i GROUP BY 1, 2""",
)
def trace_issue_report(spark, sf_dir):
    return N.issue_histogram(turn_issues(table(spark, sf_dir, "conversations")))


@query(
    "validation_report_conversations",
    _LAST + """SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, count(*) AS total
    FROM (SELECT conv_id, bool_or(la IS NOT NULL) AS ok FROM l GROUP BY conv_id)""",
)
def validation_report_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    bad = turn_issues(turns).where("level = 'error'").select("conv_id").distinct().withColumn("bad", F.lit(True))
    judged = turns.select("conv_id").distinct().join(bad, "conv_id", "left")
    return judged.agg(
        F.count_if(F.col("bad").isNull()).alias("valid"), F.count_if("bad").alias("invalid"), F.count(F.lit(1)).alias("total")
    )


def event_records(spark, sf_dir):
    """Each event as one raw JSON trace with a tool call; the event type decides what is wrong with it."""
    q = lambda c: F.to_json(F.struct(c.alias("x")))  # noqa: E731,F841
    role = lambda r, **kw: F.struct(F.lit(r).alias("role"), *[c.alias(n) for n, c in kw.items()])
    call = F.array(F.struct(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments")).alias("function")))
    user, done = role("user", content=F.col("event_type")), role("assistant", content=F.lit("done"))
    asks = role("assistant", content=F.lit(""), tool_calls=call)
    result = role("tool", content=F.col("props"))
    js = lambda *ms: F.concat(F.lit('{"messages":['), F.concat_ws(",", *[F.to_json(m) for m in ms]), F.lit("]}"))
    line = (
        F.when(F.col("event_type") == "error", js(user, result, done))
        .when(F.col("event_type") == "click", js(user, asks, result, result, done))
        .when(F.col("event_type") == "purchase", js(user, asks, done, user))
        .when(F.col("event_type") == "view", F.concat(js(user, asks, result, done), F.lit(" trailing")))
        .otherwise(js(user, asks, result, done))
    )
    from trainset.functions.text import parse_json

    # The rules are CPU-heavy; a small file arrives as one split and would keep one core busy.
    spread = table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)
    events = spread.select(F.col("event_id").alias("seq"), "event_type", parse_json(line).alias("raw"))
    return N.normalize_json(events)


_EVENT_CODES = """WITH c AS (SELECT event_type, CASE event_type WHEN 'error' THEN 'orphan_tool_result' WHEN 'click' THEN 'extra_tool_result'
  WHEN 'purchase' THEN 'unanswered_tool_calls' WHEN 'view' THEN 'invalid_json' END AS code FROM events)
"""


@query(
    "tool_linking_issues",
    _EVENT_CODES + """SELECT event_type, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT event_type, c, count(*) FROM events, (VALUES ('trailing_messages'), ('repeated_role')) AS v(c)
    WHERE event_type = 'purchase' GROUP BY 1, 2""",
)
def tool_linking_issues(spark, sf_dir):
    records = event_records(spark, sf_dir)
    found = records.select("event_type", F.explode("issues").alias("i"))
    return found.groupBy("event_type", F.col("i.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "linked_tool_results",
    """SELECT event_id AS seq, event_type AS tool, 'call_1' AS tool_call_id, CAST(json(props) AS VARCHAR) AS arguments FROM events
       WHERE event_type NOT IN ('error', 'view', 'purchase')""",
)
def linked_tool_results(spark, sf_dir):
    records = event_records(spark, sf_dir).where("valid")
    first = F.get(F.filter("messages", lambda m: m["role"] == "tool"), F.lit(0))
    call = F.get(F.get("messages", F.lit(1))["tool_calls"], F.lit(0))
    return records.where(first.isNotNull()).select(
        "seq", first["name"].alias("tool"), first["tool_call_id"].alias("tool_call_id"), call["arguments"].alias("arguments")
    )


@query(
    "content_parts",
    """SELECT page_id AS seq, CASE WHEN page_id % 3 = 0 THEN length(url) WHEN page_id % 3 = 1 THEN 2 * length(url) + 1 ELSE length(url) END AS text_chars,
      CASE WHEN page_id % 3 = 2 THEN 1 ELSE 0 END AS media, CASE WHEN page_id % 3 = 2 THEN 1 ELSE 0 END AS ignored FROM pages""",
)
def content_parts(spark, sf_dir):
    """Plain text, a list of text parts, and a list with an image and an unknown part."""
    k = F.pmod("page_id", F.lit(3))
    text = F.concat(F.lit('{"type":"text","text":'), F.to_json(F.to_variant_object(F.array("url"))), F.lit("}"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("url").alias("u"))), r'^\{"u":(.*)\}$', 1)
    part = F.concat(F.lit('{"type":"text","text":'), quoted, F.lit("}"))
    image = F.concat(F.lit('{"type":"image_url","image_url":{"url":'), quoted, F.lit("}}"))
    js = (
        F.when(k == 0, quoted)
        .when(k == 1, F.concat(F.lit("["), quoted, F.lit(","), part, F.lit("]")))
        .otherwise(F.concat(F.lit("["), part, F.lit(","), image, F.lit(',{"type":"unknown"}]')))
    )
    from trainset.functions.text import parse_json

    body = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), N.normalize_content(parse_json(js)).alias("b"))
    media = F.size(F.filter(F.coalesce("b.parts", F.array().cast(f"array<{N.ddl(N.PART)}>")), lambda p: p["type"] != "text"))
    return body.select("seq", long(F.length("b.content")).alias("text_chars"), long(media).alias("media"), long(F.col("b.ignored")).alias("ignored"))
