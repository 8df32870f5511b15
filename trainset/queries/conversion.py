"""Layout detection and conversion of source rows."""

from trainset.functions.text import json_like, render_template
from trainset.operators import convert as K
from trainset.operators.mapping import Mapping, detect_mapping
from trainset.operators.normalize import normalize_calls
from trainset.operators.traces import assemble_traces
from trainset.queries.common import WS, F, long, query, table


def content(i, field="content"):
    return F.get("messages", F.lit(i))[field]


@query(
    "detect_layouts",
    """SELECT 'documents' AS source_table, 'text' AS layout, 'text' AS column_used, count(*) AS "rows" FROM documents
       UNION ALL SELECT 'orders', 'unknown', '', count(*) FROM orders
       UNION ALL SELECT 'pairs', 'prompt_completion', 'question', count(*) FROM part
       UNION ALL SELECT 'chats', 'sharegpt', 'dialog', count(*) FROM documents
       UNION ALL SELECT 'exports', 'messages', 'payload', count(*) FROM documents
       UNION ALL SELECT 'preferences', 'preference', 'chosen', count(*) FROM benchmark""",
)
def detect_layouts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    sources = {
        "documents": docs,
        "orders": table(spark, sf_dir, "orders"),
        "pairs": table(spark, sf_dir, "part").select(F.col("p_name").alias("question"), F.col("p_type").alias("answer")),
        "chats": docs.select(F.to_json(F.array(turn("human", F.col("lang")), turn("gpt", F.col("text")))).alias("dialog")),
        "exports": docs.select("source", F.to_json(F.array(*(F.struct(F.lit(who).alias("role"), F.col(c).alias("content")) for who, c in (("user", "lang"), ("assistant", "text"))))).alias("payload")),
        "preferences": table(spark, sf_dir, "benchmark").select(F.col("text").alias("chosen"), F.col("text").alias("rejected")),
    }
    out = None
    for name, df in sources.items():
        m, _why = detect_mapping(df)
        used = (m.text or m.messages or m.prompt or m.chosen or "") if m else ""
        row = df.agg(
            F.lit(name).alias("source_table"), F.lit(m.layout if m else "unknown").alias("layout"),
            F.lit(used).alias("column_used"), F.count(F.lit(1)).alias("rows"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "convert_text_with_meta",
    """SELECT doc_id AS seq, length(text) AS chars, 'local:documents' AS meta_source, 'cc-by' AS meta_license, lang AS meta_lang,
       '{"source":"local:documents","license":"cc-by","lang":"' || lang || '"}' AS meta FROM documents""",
)
def convert_text_with_meta(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    raw = K.convert_text(docs, "text", seq="doc_id", keep=("lang",), meta={"source": "local:documents", "license": "cc-by"})
    return raw.select("seq", F.length("text").cast("long").alias("chars"), "meta_source", "meta_license", "meta_lang", "meta")


@query(
    "convert_template",
    "SELECT c_custkey AS seq, 'Customer ' || c_name || ' (nation ' || c_nationkey || ') buys {' || c_mktsegment || '}.' AS text FROM customer",
)
def convert_template(spark, sf_dir):
    template = "Customer {c_name} (nation {c_nationkey}) buys {{{c_mktsegment}}}."
    rows = K.convert_text(table(spark, sf_dir, "customer"), template=template, seq="c_custkey")
    return rows.select("seq", "text")


@query(
    "template_number_format",
    "SELECT p_partkey, printf('%05d|%.1f', CAST(p_size AS INTEGER), p_retailprice) AS label FROM part",
)
def template_number_format(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", render_template("{p_size:05d}|{p_retailprice:.1f}", df.columns).alias("label"))


@query(
    "convert_pairs",
    """SELECT p_partkey AS seq, 'Be brief.' AS system_text, p_name || chr(10) || chr(10) || p_brand AS prompt, p_type AS answer,
       'size ' || p_size AS reasoning, 3 AS messages FROM part""",
)
def convert_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("why", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    mapping = Mapping(layout="prompt_completion", prompt="p_name", input="p_brand", completion="p_type", reasoning="why", system_text="Be brief.")
    out = K.convert_table(df, mapping, "p_partkey").where("valid")
    return out.select(
        "seq", content(0).alias("system_text"), content(1).alias("prompt"), content(2).alias("answer"),
        content(2, "reasoning").alias("reasoning"), long(F.size("messages")).alias("messages"),
    )


_SPLIT = """SELECT *, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS head,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS tail FROM documents"""


def _split_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    at = F.instr("text", "\n")
    return docs.withColumn("head", F.when(at > 0, F.substr("text", F.lit(1), at - 1)).otherwise(F.col("text"))).withColumn(
        "tail", F.when(at > 0, F.substr("text", at + 1)).otherwise(F.lit(""))
    )


@query(
    "convert_chat_roles",
    f"""WITH s AS ({_SPLIT})
    SELECT doc_id AS seq, CASE WHEN trim(tail, {WS}) = '' OR trim(head, {WS}) = '' THEN
        CASE WHEN trim(head, {WS}) = '' THEN 'empty_message' ELSE 'empty_assistant' END END AS first_error,
      CASE WHEN trim(tail, {WS}) <> '' AND trim(head, {WS}) <> '' THEN 'user,assistant' END AS roles,
      CASE WHEN trim(tail, {WS}) <> '' AND trim(head, {WS}) <> '' THEN length(tail) END AS answer_chars FROM s""",
)
def convert_chat_roles(spark, sf_dir):
    turn = lambda who, c: F.struct(F.lit(who).alias("speaker"), c.alias("text"))
    df = _split_documents(spark, sf_dir).select(
        "doc_id", F.array(turn("Kunde", F.col("head")), turn("Hilfe", F.col("tail"))).alias("dialog")
    )
    mapping = Mapping(layout="sharegpt", messages="dialog", role_key="speaker", content_key="text", role_map={"Kunde": "user", "Hilfe": "assistant"})
    out = K.convert_table(df, mapping, "doc_id")
    return out.select(
        "seq", "first_error", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        long(F.length(content(1))).alias("answer_chars"),
    )


@query(
    "convert_chat_with_tools",
    """SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 1 THEN 'bad_tools' END AS first_error,
       CASE WHEN doc_id % 3 = 0 THEN 'find_' || lang END AS tool, CASE WHEN doc_id % 3 = 0 THEN '{"n":' || doc_id || ',"type":"object"}' END AS parameters FROM documents""",
)
def convert_chat_with_tools(spark, sf_dir):
    """A chat with its tool schemas in a column named ``tools``: good, unusable, and none."""
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    kind, n = F.pmod("doc_id", F.lit(3)), F.col("doc_id").cast("string")
    good = F.concat(F.lit('[{"type":"function","function":{"name":"find_'), F.col("lang"), F.lit('","parameters":{"type":"object","n":'), n, F.lit("}}}]"))
    df = table(spark, sf_dir, "documents").select(
        "doc_id", F.array(turn("human", F.col("source")), turn("gpt", F.col("lang"))).alias("conversations"),
        F.when(kind == 0, good).when(kind == 1, F.lit('[{"name": "x", "parameters": 3}]')).alias("tools"),
    )
    out = K.convert_table(df, Mapping(layout="sharegpt", messages="conversations", role_key="from", content_key="value", tools="tools"), "doc_id")
    first = F.when(F.col("valid"), F.get("tools", F.lit(0)))
    return out.select("seq", "first_error", first["name"].alias("tool"), first["parameters"].alias("parameters"))


@query(
    "function_call_turns",
    """SELECT event_id AS seq, event_type AS tool, CAST(json(props) AS VARCHAR) AS arguments, true AS args_is_object, 'call_1' AS call_id,
       'assistant' AS role FROM events""",
)
def function_call_turns(spark, sf_dir):
    call = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.lit("}"))
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    df = table(spark, sf_dir, "events").select("event_id", F.array(turn("human", F.col("event_type")), turn("function_call", call)).alias("conversations"))
    out = K.convert_table(df, Mapping(layout="sharegpt", messages="conversations", role_key="from", content_key="value"), "event_id")
    made = F.get(content(1, "tool_calls"), F.lit(0))
    return out.select(
        "seq", made["name"].alias("tool"), made["arguments"].alias("arguments"), made["args_is_object"].alias("args_is_object"),
        made["id"].alias("call_id"), content(1, "role").alias("role"),
    )


@query(
    "convert_preferences",
    f"""WITH s AS (SELECT d.doc_id, trim(left(d.text, 40), {WS}) AS ask, trim(d.text, {WS}) AS body, l.quality FROM documents d JOIN labels l USING (doc_id))
    SELECT doc_id AS seq, CASE WHEN ask <> '' THEN ask END AS prompt, CASE WHEN ask <> '' THEN length(body) END AS chosen_chars,
      CASE WHEN ask <> '' THEN length(body) + 1 END AS rejected_chars, CASE WHEN ask = '' THEN 'empty_message' END AS first_error FROM s""",
)
def convert_preferences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    from trainset.functions.text import strip

    ask, body = strip(F.substring("text", 1, 40)), strip(F.col("text"))
    said = lambda answer: F.concat(F.lit("\n\nHuman: "), ask, F.lit("\n\nAssistant: "), answer)
    df = docs.select("doc_id", said(body).alias("chosen"), said(F.concat(body, F.lit("!"))).alias("rejected"))
    out = K.convert_table(df, Mapping(layout="preference", chosen="chosen", rejected="rejected"), "doc_id")
    alt = lambda side: long(F.length(F.get(side, F.lit(0))["content"]))
    return out.select("seq", content(0).alias("prompt"), alt("chosen").alias("chosen_chars"), alt("rejected").alias("rejected_chars"), "first_error")


@query(
    "parse_transcripts",
    f"""SELECT doc_id, 3 AS turns, 'user,assistant,user' AS roles, length(trim(text, {WS})) AS answer_chars, source AS last_text FROM documents""",
)
def parse_transcripts(spark, sf_dir):
    said = F.concat(F.lit("Human: "), F.col("lang"), F.lit("\n\nAssistant:\n"), F.col("text"), F.lit("\n\nH: "), F.col("source"))
    parsed = table(spark, sf_dir, "documents").select("doc_id", K.parse_transcript(said).alias("messages"))
    return parsed.select(
        "doc_id", long(F.size("messages")).alias("turns"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        long(F.length(content(1))).alias("answer_chars"), content(2).alias("last_text"),
    )


@query(
    "stringify_values",
    """SELECT doc_id, replace(text, ' ', chr(10)) AS as_lines, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS as_json,
       CAST(n_chars AS VARCHAR) AS as_text FROM documents""",
)
def stringify_values(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(
        "doc_id", F.split("text", " ").alias("words"), F.struct("doc_id", "lang").alias("pair"), "n_chars"
    )
    return df.select("doc_id", K.stringify(df, "words").alias("as_lines"), K.stringify(df, "pair").alias("as_json"), K.stringify(df, "n_chars").alias("as_text"))


@query(
    "parse_json_strings",
    """SELECT event_type, count(*) AS parsed, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1
       UNION ALL SELECT 'document', count(*) FILTER (left(ltrim(text), 1) IN ('[', '{') AND json_valid(text)), NULL FROM documents""",
)
def parse_json_strings(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("v", json_like(F.col("props")))
    k = F.try_variant_get("v", "$.k", "long")
    counted = events.groupBy("event_type").agg(F.count("v").alias("parsed"), F.sum(k).alias("k_sum"))
    docs = table(spark, sf_dir, "documents").agg(
        F.lit("document").alias("event_type"), F.count(json_like(F.col("text"))).alias("parsed"), F.lit(None).cast("long").alias("k_sum")
    )
    return counted.unionByName(docs)


@query(
    "convert_reject_reasons",
    f"""SELECT CASE WHEN lang <> 'en' THEN 'convert: no list in column dialog' ELSE 'nothing_to_learn' END AS reason, count(*) AS n
        FROM documents WHERE lang <> 'en' OR source < 's' GROUP BY 1
        UNION ALL SELECT 'convert: an item of the conversation is no object', count(*) FROM documents WHERE lang = 'en' AND source >= 's' HAVING count(*) > 0""",
)
def convert_reject_reasons(spark, sf_dir):
    item = F.struct(F.lit("user").alias("role"), F.lit("hello").alias("content"))
    dialog = F.when(F.col("lang") != "en", F.col("lang")).when(F.col("source") < "s", F.to_json(F.array(item))).otherwise(F.lit('["x"]'))
    df = table(spark, sf_dir, "documents").select("doc_id", dialog.alias("dialog"))
    return K.convert_report(K.convert_table(df, Mapping(layout="messages", messages="dialog"), "doc_id"))


@query(
    "tool_call_arguments",
    """SELECT event_type, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS objects,
       count(*) FILTER (event_type = 'error') AS unparsed FROM events GROUP BY 1""",
)
def tool_call_arguments(spark, sf_dir):
    """Arguments given as JSON text are parsed; broken text is kept and reported."""
    text = F.when(F.col("event_type") == "error", F.concat(F.col("props"), F.lit("!"))).otherwise(F.col("props"))
    call = F.struct(F.struct(F.col("event_type").alias("name"), text.alias("arguments")).alias("function"))
    df = table(spark, sf_dir, "events").select("event_type", F.explode(normalize_calls(F.to_variant_object(call))).alias("c"))
    return df.groupBy("event_type").agg(
        F.count("c.call").alias("calls"), F.count_if("c.call.args_is_object").alias("objects"),
        F.count_if(F.col("c.code") == "unparsed_arguments").alias("unparsed"),
    )


@query("turns_round_trip", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def turns_round_trip(spark, sf_dir):
    """Turn rows to nested records and back; conversations beyond the row bound stay turn rows."""
    turns = table(spark, sf_dir, "conversations")
    records, longer = assemble_traces(turns, "conv_id", "turn", max_turns=4)
    back = records.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", long(F.col("turn")).alias("turn"), "m.*")
    both = back.unionByName(longer.select(*back.columns))
    return both.select("conv_id", "turn", "role", long(F.length("text")).alias("chars"))
