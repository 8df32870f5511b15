"""Rendering conversations in three dialects, with loss spans."""

from trainset.operators import render as R
from trainset.operators.traces import turns_without_trailing
from trainset.queries.common import WS, F, long, query, table
from trainset.schema import TOOL


def turns(spark, sf_dir):
    """Conversations cut after their last answer, content column named as in records."""
    return turns_without_trailing(table(spark, sf_dir, "conversations")).withColumnRenamed("text", "content")


_CUT = """WITH l AS (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS la FROM conversations),
c AS (SELECT *, row_number() OVER w - 1 AS pos, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS lu,
  lag(role) OVER w AS prev, lead(role) OVER w AS nxt FROM l WHERE turn <= la WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) """
_THINK = "<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || '"


def _rendered_sql(head: str, end: str, after: str, think: str = "") -> str:
    """SQL for turns that need no merging: header, body, end marker."""
    th = f"CASE WHEN role = 'assistant' AND (lu IS NULL OR turn > lu) THEN '{think}' ELSE '' END" if think else "''"
    return _CUT + f"""SELECT conv_id, turn, role, md5({head} || {th} || text || '{end}' || {after}) AS digest,
      length({head} || {th} || text || '{end}' || {after}) AS chars,
      CASE WHEN role = 'assistant' THEN length(text) + {len(end)} ELSE 0 END AS trainable_chars FROM c"""


def flat(rendered):
    return rendered.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), long(F.length("text")).alias("chars"), "trainable_chars"
    )


TOOLS_HEAD_SQL = " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in R.TOOLS_PREAMBLE.split("\n"))


@query("render_chatml", _rendered_sql("('<|im_start|>' || role || chr(10))", "<|im_end|>", "chr(10)", _THINK))
def render_chatml(spark, sf_dir):
    return flat(R.render_turns(turns(spark, sf_dir), R.CHATML))


@query(
    "render_header_id",
    _rendered_sql(
        "((CASE WHEN pos = 0 THEN '<|begin_of_text|>' ELSE '' END) || '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10))",
        "<|eot_id|>", "''",
    ),
)
def render_header_id(spark, sf_dir):
    return flat(R.render_turns(turns(spark, sf_dir), R.HEADER_ID))


_ALTER = """(SELECT conv_id, turn, CASE WHEN role = 'system' THEN role WHEN turn % 3 = 0 THEN 'user' ELSE 'assistant' END AS role, text FROM conversations)"""
_MERGE_CUT = _CUT.replace("FROM conversations)", f"FROM {_ALTER})", 1)


def merged_turns(spark, sf_dir):
    """Turns regrouped so that one side often speaks twice in a row."""
    role = F.when(F.col("role") == "system", F.lit("system")).when(F.pmod("turn", F.lit(3)) == 0, F.lit("user")).otherwise(F.lit("assistant"))
    df = table(spark, sf_dir, "conversations").withColumn("role", role)
    return turns_without_trailing(df).withColumnRenamed("text", "content")


@query(
    "render_merged_roles",
    _MERGE_CUT + f""", m AS (SELECT *, role IN ('user', 'assistant') AND prev IS NOT DISTINCT FROM role AS joined,
      role IN ('user', 'assistant') AND nxt IS NOT DISTINCT FROM role AS goes_on FROM c),
    p AS (SELECT *, CASE WHEN joined THEN chr(10) || chr(10) ELSE (CASE WHEN pos = 0 THEN '<bos>' ELSE '' END) || '<start_of_turn>' ||
        CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10) END AS head,
      CASE WHEN goes_on THEN rtrim(text, {WS}) ELSE text || '<end_of_turn>' END AS body, CASE WHEN goes_on THEN '' ELSE chr(10) END AS tail FROM m)
    SELECT conv_id, turn, role, md5(head || body || tail) AS digest, length(head || body || tail) AS chars,
      CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END AS trainable_chars FROM p""",
)
def render_merged_roles(spark, sf_dir):
    return flat(R.render_turns(merged_turns(spark, sf_dir), R.TURN_TAG))


@query(
    "merge_same_roles",
    _MERGE_CUT + """SELECT conv_id, count(*) FILTER (NOT (role IN ('user', 'assistant') AND prev IS NOT DISTINCT FROM role)) AS merged_turns, count(*) AS turns
    FROM c GROUP BY conv_id""",
)
def merge_same_roles(spark, sf_dir):
    ctx = R.with_context(merged_turns(spark, sf_dir), R.TURN_TAG)
    joined = F.col("out_role").isin("user", "assistant") & F.coalesce(F.col("prev_role") == F.col("out_role"), F.lit(False))
    return ctx.groupBy("conv_id").agg(F.count_if(~joined).alias("merged_turns"), F.count(F.lit(1)).alias("turns"))


@query(
    "train_on_last",
    _CUT + "SELECT conv_id, CAST(sum(CASE WHEN turn = la THEN length(text) + 10 ELSE 0 END) AS BIGINT) AS trainable_chars FROM c GROUP BY conv_id",
)
def train_on_last(spark, sf_dir):
    return R.rendered_totals(R.render_turns(turns(spark, sf_dir), R.CHATML, train_on="last")).select("conv_id", "trainable_chars")


@query(
    "train_on_all",
    _CUT + f"""SELECT conv_id, CAST(sum(length(text) + length(role) + 24 + CASE WHEN role = 'assistant' AND (lu IS NULL OR turn > lu) THEN 19 ELSE 0 END) AS BIGINT) AS trainable_chars
    FROM c GROUP BY conv_id""",
)
def train_on_all(spark, sf_dir):
    return R.rendered_totals(R.render_turns(turns(spark, sf_dir), R.CHATML, train_on="all")).select("conv_id", "trainable_chars")


@query(
    "conversation_with_chosen",
    """SELECT conv_id, count(*) + 1 AS messages, CAST(sum(length(text)) + max(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""",
)
def conversation_with_chosen(spark, sf_dir):
    """Preference traces render their messages plus the chosen continuation: one more turn."""
    all_turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    chosen = all_turns.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max("n").alias("n")).withColumn("turn", F.col("turn") + 1)
    both = all_turns.unionByName(chosen)
    return both.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("n").alias("chars"))


@query(
    "inline_reasoning",
    _CUT + f"""SELECT conv_id, turn, length(text) + CASE WHEN role = 'assistant' AND left(text, 12) <> '' THEN length(left(text, 12)) + 19 ELSE 0 END
      + CASE WHEN pos = 0 THEN 17 ELSE 0 END + length(role) + 48 AS chars FROM c""",
)
def inline_reasoning(spark, sf_dir):
    df = turns(spark, sf_dir).withColumn("reasoning", F.when(F.col("role") == "assistant", F.substring("content", 1, 12)))
    return R.render_turns(df, R.HEADER_ID).select("conv_id", "turn", long(F.length("text")).alias("chars"))


@query(
    "expand_reasoning_turns",
    _CUT + f""", s AS (SELECT *, length(role) + length(text) + 24 AS hist,
      sum(length(role) + length(text) + 24) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS fa FROM c)
    SELECT conv_id, turn, pos + 1 AS messages, CAST(coalesce(before, 0) + hist + length(left(text, 12)) + 19 AS BIGINT) AS chars,
      length(text) + 10 + length(left(text, 12)) + 19 AS trainable_chars FROM s WHERE role = 'assistant' AND fa < la""",
)
def expand_reasoning_turns(spark, sf_dir):
    df = turns(spark, sf_dir).withColumn("reasoning", F.when(F.col("role") == "assistant", F.substring("content", 1, 12)))
    return R.expand_turns(df, R.CHATML)


@query(
    "system_notes",
    """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'system' ELSE role END AS role, text FROM conversations),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
      min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nu FROM a)
    SELECT conv_id, turn, nu AS moved_to, length(text) + 16 AS chars FROM p WHERE role = 'system' AND pos > 0 AND nu IS NOT NULL""",
)
def system_notes(spark, sf_dir):
    role = F.when(F.pmod("turn", F.lit(4)) == 3, F.lit("system")).otherwise(F.col("role"))
    df = table(spark, sf_dir, "conversations").withColumn("role", role).withColumnRenamed("text", "content")
    out = R.render_turns(df, R.CHATML)
    return out.where((F.col("role") == "system") & (F.col("pos") > 0)).select(
        "conv_id", "turn", F.col("at").alias("moved_to"), long(F.length("text")).alias("chars")
    )


@query(
    "tool_call_text",
    """SELECT event_id, 'ok' || chr(10) || '<tool_call>' || chr(10) || '{"name": "' || event_type || '", "arguments": ' || CAST(json(props) AS VARCHAR) || '}'
       || chr(10) || '</tool_call>' AS text FROM events""",
)
def tool_call_text(spark, sf_dir):
    call = F.struct(F.col("event_type").alias("name"), F.regexp_replace("props", ": ", ":").alias("arguments"), F.lit(True).alias("args_is_object"))
    return table(spark, sf_dir, "events").select("event_id", R.with_tool_calls(F.lit("ok "), F.array(call)).alias("text"))


@query(
    "documents_preamble",
    f"""SELECT doc_id, 'You help.' || chr(10) || chr(10) || 'Use the following documents to answer:' || chr(10) || chr(10) || '[1] ' || source || chr(10) || text
       || chr(10) || chr(10) || '[2]' || chr(10) || lang AS system_text FROM documents""",
)
def documents_preamble(spark, sf_dir):
    doc = lambda text, title: F.struct(text.alias("text"), title.alias("title"))
    docs = F.array(doc(F.col("text"), F.col("source")), doc(F.col("lang"), F.lit("")))
    none = F.lit(None).cast(f"array<{TOOL.simpleString()}>")
    system = R.with_preamble(F.lit("system"), F.lit("You help.\n"), R.preamble(docs, none))
    return table(spark, sf_dir, "documents").select("doc_id", system.alias("system_text"))


@query(
    "tools_preamble",
    f"""SELECT p_partkey, {TOOLS_HEAD_SQL} || '{{"name":"' || p_name || '","description":"' || p_type || '","parameters":{{"type":"object","size":' || CAST(p_size AS BIGINT) || '}}}}' || chr(10)
       || '{{"name":"other","parameters":{{}},"strict":true}}' AS system_text FROM part""",
)
def tools_preamble(spark, sf_dir):
    """Two tools for each part; what is JSON in a tool stays JSON in the text."""
    def tool(**given):
        values = {f.name: F.lit(None).cast(f.dataType) for f in TOOL.fields} | given
        return F.struct(*[values[f.name].alias(f.name) for f in TOOL.fields])

    schema = F.concat(F.lit('{"type":"object","size":'), F.col("p_size").cast("long").cast("string"), F.lit("}"))
    tools = F.array(
        tool(name=F.col("p_name"), description=F.col("p_type"), parameters=schema),
        tool(name=F.lit("other"), parameters=F.lit("{}"), strict=F.lit(True)),
    )
    text = R.with_preamble(F.lit("user"), F.lit("hi"), R.preamble(F.lit(None).cast("array<struct<text:string,title:string>>"), tools))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("system_text"))


@query(
    "excluded_regions",
    """SELECT event_id, 3 AS pieces, length(event_type) + 17 + 4 AS trainable_chars, length(props) + 16 AS masked_chars FROM events""",
)
def excluded_regions(spark, sf_dir):
    text = F.concat("event_type", F.lit("<|tool_response>"), "props", F.lit("<tool_response|>"), F.lit(" done"))
    cut = table(spark, sf_dir, "events").select("event_id", R.exclude_regions(text, R.TURN_TAG_MERGED.exclude_within_turn).alias("p"))
    chars = lambda flag: F.aggregate(F.filter("p", lambda x: x["trainable"] == flag), F.lit(0).cast("long"), lambda a, x: a + F.length(x["piece"]))
    return cut.select("event_id", long(F.size("p")).alias("pieces"), chars(True).alias("trainable_chars"), chars(False).alias("masked_chars"))


@query(
    "extract_turns",
    """SELECT doc_id, 2 AS turns, length(text) AS first_chars, source AS second FROM documents""",
)
def extract_turns(spark, sf_dir):
    """Answers found again in rendered text."""
    a = lambda c: F.concat(F.lit("<|im_start|>assistant\n"), c, F.lit("<|im_end|>\n"))
    text = F.concat(F.lit("<|im_start|>user\nhi<|im_end|>\n"), a(F.col("text")), a(F.col("source")))
    found = table(spark, sf_dir, "documents").select("doc_id", R.extract_turns(text, R.CHATML).alias("t"))
    return found.select("doc_id", long(F.size("t")).alias("turns"), long(F.length(F.get("t", F.lit(0)))).alias("first_chars"), F.get("t", F.lit(1)).alias("second"))


@query(
    "preview_segments",
    _CUT + f""", f AS (SELECT DISTINCT conv_id FROM c ORDER BY conv_id LIMIT 2)
    SELECT conv_id, turn AS "at", piece, trainable FROM (SELECT conv_id, turn, '<|im_start|>' || role || chr(10) AS piece, false AS trainable FROM c
      UNION ALL SELECT conv_id, turn, '{_THINK}', false FROM c WHERE role = 'assistant' AND (lu IS NULL OR turn > lu)
      UNION ALL SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text || '<|im_end|>' ELSE text END, role = 'assistant' FROM c
      UNION ALL SELECT conv_id, turn, '<|im_end|>', false FROM c WHERE role <> 'assistant'
      UNION ALL SELECT conv_id, turn, chr(10), false FROM c) WHERE conv_id IN (SELECT conv_id FROM f) AND piece <> ''""",
)
def preview_segments(spark, sf_dir):
    return R.preview(R.render_turns(turns(spark, sf_dir), R.CHATML), 2).select("conv_id", "at", "piece", "trainable")
