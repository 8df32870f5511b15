"""Source rows to raw records: one function per layout, all of them per-row expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from trainset.functions import variants as V
from trainset.functions.text import is_blank, json_like, render_template, rstrip, strip
from trainset.operators.mapping import CHAT_KEYS, Mapping
from trainset.operators.normalize import (
    build_message, message_of_columns, normalize_columns, normalize_messages, normalize_tools, null, read_message, with_body,
)

SIMPLE = "array<struct<role:string,content:string>>"
ANSWER_ROLES = ("assistant", "gpt", "model", "bot")  # fixed values: where a transcript is split
HUMAN_MARKS = ("Human", "H")


def stringify(df: DataFrame, name: str) -> Column:
    """Text of a column of any type: strings as they are, string lists by line, the rest as JSON."""
    dtype, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        return F.coalesce(F.array_join(c, "\n"), F.lit(""))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def as_variant(df: DataFrame, name: str) -> Column:
    """Lists and structs, or JSON text, as VARIANT; other text stays a string VARIANT."""
    dtype, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(dtype, T.VariantType):
        return c
    if isinstance(dtype, T.StringType):
        return F.coalesce(json_like(c), F.try_variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant"))
    return F.try_variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant")


def with_meta(df: DataFrame, meta: dict[str, str] | None, keep_meta: Sequence[str] = ()) -> DataFrame:
    """Provenance: constants (source, license) plus kept columns as JSON and promoted columns."""
    pairs = [F.lit(v).alias(k) for k, v in (meta or {}).items() if k not in keep_meta]
    pairs += [F.col(f"`{k}`").alias(k) for k in keep_meta]
    packed = F.to_json(F.struct(*pairs)) if pairs else null("string")
    known = {**(meta or {})}

    def promoted(name: str) -> Column:
        if name in keep_meta:
            return F.col(f"`{name}`").cast("string")
        return F.lit(known[name]) if name in known else null("string")

    return df.withColumn("meta", packed).withColumns(
        {f"meta_{n}": promoted(n) for n in ("source", "license", "lang")}
    )


def convert_text(
    df: DataFrame, text: str = "text", template: str | None = None, seq: str = "seq", keep: Sequence[str] = (),
    meta: dict[str, str] | None = None,
) -> DataFrame:
    """Layout ``text``: one document per row, from a column or a template over columns."""
    body = render_template(template, df.columns) if template else stringify(df, text)
    source = with_meta(df, meta, [k for k in keep]) if (meta or keep) else df
    extra = ["meta", "meta_source", "meta_license", "meta_lang"] if (meta or keep) else []
    columns = [c for c in keep if c not in ("text", seq)]
    return source.select(F.col(seq).cast("long").alias("seq"), F.lit("text").alias("kind"), body.alias("text"), *columns, *extra)


def convert_chat(
    df: DataFrame, messages: str, role_key: str = "role", content_key: str = "content", role_map: dict[str, str] | None = None
) -> DataFrame:
    """Layouts ``messages``/``sharegpt``: add ``built`` (canonical messages with issues) and ``convert_error``."""
    raw = as_variant(df, messages)
    read = F.transform(V.items(F.col("__raw")), lambda m: read_message(m, (role_key,), (content_key,), role_map))
    error = F.when(~V.is_array(F.col("__raw")) | F.col("__raw").isNull(), F.lit(f"no list in column {messages}")).when(
        F.exists(V.items(F.col("__raw")), lambda m: ~V.is_object(m)), F.lit("an item of the conversation is no object")
    )
    return (
        df.withColumn("__raw", raw)
        .withColumn("convert_error", error)
        .withColumn("built", F.transform(F.transform(read, with_body), build_message))
        .drop("__raw")
    )


def system_message(df: DataFrame, mapping: Mapping) -> Column:
    """The system text of a row: its column beats the constant; NULL for none."""
    constant = F.lit(mapping.system_text) if mapping.system_text else null("string")
    if not mapping.system:
        return F.nullif(constant, F.lit(""))
    return F.nullif(F.coalesce(F.nullif(stringify(df, mapping.system), F.lit("")), constant), F.lit(""))


def prepend_system(messages: Column, system: Column) -> Column:
    """Add a leading system turn unless the record already starts with one."""
    first = F.lower(F.try_element_at(messages, F.lit(1))["role"])
    leads = F.coalesce(first.isin("system", "developer"), F.lit(False))
    lead = F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))).cast(SIMPLE)
    return F.when(system.isNotNull() & ~leads, F.concat(lead, messages)).otherwise(messages)


def pair_columns(df: DataFrame, mapping: Mapping) -> tuple[Column, Column, Column]:
    """Prompt, answer and reasoning text of the pair layouts."""
    if mapping.prompt_template:
        prompt = render_template(mapping.prompt_template, df.columns)
    else:
        prompt = stringify(df, mapping.prompt or "prompt")
        if mapping.input:
            extra = stringify(df, mapping.input)
            prompt = F.when(is_blank(extra), prompt).otherwise(F.concat(rstrip(prompt), F.lit("\n\n"), strip(extra)))
    if mapping.completion_template:
        answer = render_template(mapping.completion_template, df.columns)
    else:
        answer = stringify(df, mapping.completion or "completion")
    reasoning = stringify(df, mapping.reasoning) if mapping.reasoning else null("string")
    return prompt, answer, reasoning


def convert_pairs(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Layouts ``alpaca``/``prompt_completion``: a user turn and an assistant turn."""
    prompt, answer, reasoning = pair_columns(df, mapping)
    system = system_message(df, mapping)
    turns = F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content"), null("string").alias("reasoning")),
        F.struct(F.lit("user").alias("role"), prompt.alias("content"), null("string").alias("reasoning")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content"), reasoning.alias("reasoning")),
    )
    turns = F.filter(turns, lambda t: (t["role"] != "system") | t["content"].isNotNull())
    built = F.transform(
        F.transform(turns, lambda t: message_of_columns(t["role"], t["content"], t["reasoning"])), build_message
    )
    return df.withColumn("built", built).withColumn("convert_error", null("string"))


def parse_transcript(text: Column) -> Column:
    """``\\n\\nHuman: … \\n\\nAssistant: …`` to ``array<struct<role, content>>``."""
    padded = F.concat(F.lit("\n\n"), F.ltrim(text, F.lit(" \t\n\r\x0b\x0c")))
    chunks = F.split(padded, r"(?=\n\n(?:Human|Assistant|H|A):)")
    pattern = r"(?s)^\n\n(Human|Assistant|H|A):\s?(.*)$"
    read = F.transform(
        chunks,
        lambda c: F.struct(
            F.regexp_extract(c, pattern, 1).alias("mark"), strip(F.regexp_extract(c, pattern, 2)).alias("content")
        ),
    )
    return F.transform(
        F.filter(read, lambda x: x["mark"] != ""),
        lambda x: F.struct(
            F.when(x["mark"].isin(*HUMAN_MARKS), F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
            x["content"].alias("content"),
        ),
    )


def simple_messages(df: DataFrame, name: str) -> Column:
    """``array<struct<role, content>>`` of an alternative: message list, transcript or answer text."""
    dtype = df.schema[name].dataType
    v = as_variant(df, name)

    def item(m: Column) -> Column:
        role = F.coalesce(*[V.text(V.get(m, r)) for r, _ in CHAT_KEYS])
        content = F.coalesce(*[V.scalar_text(V.get(m, c)) for _, c in CHAT_KEYS])
        return F.struct(F.trim(role).alias("role"), content.alias("content"))

    def answer(c: Column) -> Column:
        return F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce(c, F.lit("")).alias("content"))).cast(SIMPLE)

    if not isinstance(dtype, T.StringType):
        return F.when(V.is_array(v), F.transform(V.items(v), item).cast(SIMPLE)).otherwise(answer(stringify(df, name)))
    text = F.col(f"`{name}`")
    marked = F.concat(F.lit("\n\n"), F.ltrim(text, F.lit(" \t\n\r\x0b\x0c"))).contains("\n\nHuman:") | text.contains("\n\nAssistant:")
    parsed = json_like(text)
    is_chat = V.is_array(parsed) & V.is_object(F.try_variant_get(parsed, "$[0]", "variant"))
    return (
        F.when(F.coalesce(is_chat, F.lit(False)), F.transform(V.items(parsed), item).cast(SIMPLE))
        .when(marked, parse_transcript(text).cast(SIMPLE))
        .otherwise(answer(text))
    )


def split_alternative(messages: Column) -> Column:
    """``struct<before, answer>``: split where the last answer starts."""
    hits = F.transform(messages, lambda m, i: F.when(F.lower(m["role"]).isin(*ANSWER_ROLES), i).otherwise(F.lit(-1)))
    last = F.coalesce(F.array_max(hits), F.lit(-1))
    return F.when(
        last >= 0,
        F.struct(
            F.slice(messages, F.lit(1), last).alias("before"),
            F.slice(messages, last + 1, F.size(messages)).alias("answer"),
        ),
    ).otherwise(F.struct(messages.alias("before"), F.slice(messages, 1, 0).alias("answer")))


def convert_preference(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Layout ``preference``: prompt messages plus ``__chosen``/``__rejected`` alternatives."""
    prompt_text = stringify(df, mapping.prompt) if mapping.prompt else F.lit("")
    asked = F.array(F.struct(F.lit("user").alias("role"), prompt_text.alias("content"))).cast(SIMPLE)
    df = df.withColumn("__c", split_alternative(simple_messages(df, mapping.chosen or "chosen"))).withColumn(
        "__r", split_alternative(simple_messages(df, mapping.rejected or "rejected"))
    )
    before = F.col("__c.before")
    if mapping.messages:
        explicit = simple_messages(df, mapping.messages)
        before = F.when(F.col(f"`{mapping.messages}`").isNotNull(), explicit).otherwise(before)
    prompt = F.when(F.size(before) > 0, before).when(prompt_text != "", asked).otherwise(F.array().cast(SIMPLE))
    asks = F.exists(prompt, lambda m: F.lower(m["role"]).isin("user", "human"))
    prompt = F.when((prompt_text != "") & ~asks, F.concat(asked, prompt)).otherwise(prompt)
    prompt = prepend_system(prompt, system_message(df, mapping))

    def built(c: Column) -> Column:
        return F.transform(F.transform(c, lambda m: message_of_columns(m["role"], m["content"])), build_message)

    def side(c: Column, label: str) -> Column:
        b = built(c)
        messages = F.transform(F.filter(b, lambda x: x["m"].isNotNull()), lambda x: x["m"])
        from trainset.operators.normalize import when_issue

        empty_side = F.size(c) <= 0
        return F.struct(
            F.when(~empty_side, messages).alias("messages"),
            F.concat(
                F.flatten(F.transform(b, lambda x: x["issues"])),
                when_issue(empty_side, "error", f"bad_{label}", f"nothing usable as an answer in {label}"),
            ).alias("issues"),
        )

    return (
        df.withColumn("__prompt", prompt)
        .withColumn("built", built(F.col("__prompt")))
        .withColumn("__chosen", side(F.col("__c.answer"), "chosen"))
        .withColumn("__rejected", side(F.col("__r.answer"), "rejected"))
        .withColumn("convert_error", null("string"))
        .drop("__c", "__r", "__prompt")
    )


def convert_table(df: DataFrame, mapping: Mapping, seq: str = "seq", meta: dict[str, str] | None = None) -> DataFrame:
    """Convert and validate a whole table: canonical columns plus issues, valid and first_error.

    Rows that cannot be converted keep a ``convert: …`` reason in first_error; nothing raises.
    """
    if mapping.layout == "text":
        raw = convert_text(df, mapping.text or "text", mapping.prompt_template, seq, mapping.keep_meta, meta)
        return normalize_columns(raw)
    source = with_meta(df, meta, mapping.keep_meta)
    if mapping.layout in ("messages", "sharegpt"):
        built = convert_chat(source, mapping.messages or "messages", mapping.role_key, mapping.content_key, mapping.role_map)
        system = system_message(source, mapping)
        lead = F.transform(
            F.array(message_of_columns(F.lit("system"), system)), build_message
        )
        starts = F.coalesce(F.try_element_at(F.col("built"), F.lit(1))["m"]["role"] == "system", F.lit(False))
        built = built.withColumn("built", F.when(system.isNotNull() & ~starts, F.concat(lead, F.col("built"))).otherwise(F.col("built")))
    elif mapping.layout == "preference":
        built = convert_preference(source, mapping)
    else:
        built = convert_pairs(source, mapping)
    if mapping.tools:
        built = built.withColumn("__tools", normalize_tools(as_variant(built, mapping.tools)))
    out = normalize_messages(built, F.col("built"))
    reason = F.when(F.col("convert_error").isNotNull(), F.concat(F.lit("convert: "), F.col("convert_error"))).otherwise(F.col("first_error"))
    keep = ["kind", "messages", "chosen", "rejected", "tools", "meta", "meta_source", "meta_license", "meta_lang", "issues"]
    return out.select(
        F.col(seq).cast("long").alias("seq"), *keep, reason.alias("first_error"), reason.isNull().alias("valid")
    )


def convert_report(converted: DataFrame) -> DataFrame:
    """Rejected rows by reason."""
    return converted.where(~F.col("valid")).groupBy(F.col("first_error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
