"""Conversations in two shapes: nested records, and tables with one row per turn.

A nested record arrives as one row, so its rules are array expressions and never shuffle.
A turn table may hold a conversation of any length, so its rules are group aggregates and
blocked scans; only results of bounded size are ever collected into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trainset.functions.roles import canonical_role
from trainset.functions.text import is_blank, strip, text_or_empty
from trainset.operators.ordered import scan_groups

BLOCK = 1024


# ---- content of nested records ---------------------------------------------------------


def content_text(message: Column) -> Column:
    """Plain text of a message: its content, or the text parts joined by line breaks."""
    parts = F.filter(message["parts"], lambda p: p["type"] == "text")
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    return F.coalesce(F.when(message["parts"].isNotNull(), joined), message["content"], F.lit(""))


def media_parts(message: Column) -> Column:
    return F.filter(
        F.coalesce(message["parts"], F.array().cast(message_parts_type())), lambda p: p["type"] != "text"
    )


def message_parts_type() -> str:
    from trainset.schema import PART

    return f"array<{PART.simpleString()}>"


def message_chars(message: Column) -> Column:
    return F.length(content_text(message)) + F.length(text_or_empty(message["reasoning"]))


def total_chars(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda acc, m: acc + message_chars(m))


def last_index(messages: Column, role: str) -> Column:
    """0-based index of the last message of a role, -1 if there is none."""
    hits = F.transform(messages, lambda m, i: F.when(m["role"] == role, i).otherwise(F.lit(-1)))
    return F.coalesce(F.array_max(hits), F.lit(-1))


def conversation(messages: Column, chosen: Column) -> Column:
    """What gets rendered: the messages plus the preferred continuation."""
    return F.when(chosen.isNull(), messages).otherwise(F.concat(messages, chosen))


def drop_trailing(messages: Column) -> Column:
    """Cut everything after the last assistant turn."""
    return F.slice(messages, F.lit(1), last_index(messages, "assistant") + 1)


def drop_reasoning(messages: Column) -> Column:
    return F.transform(messages, lambda m: m.withField("reasoning", F.lit(None).cast("string")))


def record_chars() -> Column:
    """Length of a record in characters, by kind."""
    return (
        F.when(F.col("kind") == "trace", total_chars(F.col("messages")))
        .when(F.col("kind") == "image", F.length(text_or_empty(F.col("caption"))))
        .when(F.col("kind") == "completion", F.length(F.col("prompt")) + F.length(F.col("completion")))
        .otherwise(F.length(F.col("text")))
        .cast("long")
    )


def fingerprint() -> Column:
    """sha1 of what is learned from a record; id, meta, tools and loss flags do not count."""

    def view(m: Column) -> Column:
        return F.struct(
            m["role"].alias("r"),
            strip(content_text(m)).alias("c"),
            text_or_empty(m["reasoning"]).alias("t"),
            m["tool_calls"].alias("k"),
            media_parts(m).alias("p"),
        )

    trace = F.to_json(
        F.struct(
            F.transform(F.col("messages"), view).alias("m"),
            F.col("chosen").alias("y"),
            F.col("rejected").alias("n"),
        )
    )
    image = F.to_json(F.struct("image", "caption", "captions", "references"))
    pair = F.to_json(F.struct("prompt", "completion"))
    payload = (
        F.when(F.col("kind") == "trace", trace)
        .when(F.col("kind") == "image", image)
        .when(F.col("kind") == "completion", pair)
        .otherwise(strip(F.col("text")))
    )
    return F.sha1(F.concat(F.col("kind"), F.lit(":"), payload))


def text_fingerprint(text: Column) -> Column:
    """The fingerprint of a plain text record, usable before records are built."""
    return F.sha1(F.concat(F.lit("text:"), strip(text)))


def with_text_parts(records: DataFrame) -> DataFrame:
    """Add user/assistant/other text lists, the joined text, and the emptiness and length columns."""
    none = F.array().cast("array<string>")

    def texts(role_test) -> Column:
        return F.coalesce(F.transform(F.filter(F.col("messages"), role_test), content_text), none)

    def alternative(name: str) -> Column:
        joined = F.array_join(F.transform(F.col(name), content_text), " ")
        return F.when(F.col(name).isNotNull(), F.array(joined)).otherwise(none)

    def single(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.array(F.col(name))).otherwise(none)

    user = F.concat(texts(lambda m: m["role"] == "user"), single("prompt"))
    assistant = F.concat(
        texts(lambda m: m["role"] == "assistant"), alternative("chosen"), alternative("rejected"), single("completion")
    )
    other = F.concat(texts(lambda m: ~m["role"].isin("user", "assistant")), single("text"))
    blank_user = F.exists(F.col("user_texts"), is_blank)
    last_answer = F.try_element_at(F.col("assistant_texts"), F.lit(-1))
    return (
        records.withColumn("user_texts", user)
        .withColumn("assistant_texts", assistant)
        .withColumn("other_texts", other)
        .withColumn(
            "empty",
            F.when(F.col("kind") == "trace", blank_user | is_blank(last_answer))
            .when(F.col("kind") == "text", is_blank(F.col("text")))
            .otherwise(~F.exists(F.col("assistant_texts"), lambda t: ~is_blank(t)) | blank_user),
        )
        .withColumn("everything", F.array_join(F.concat("user_texts", "assistant_texts", "other_texts"), "\n"))
        .withColumn("all_chars", F.length("everything").cast("long"))
        .withColumn(
            "answer_chars",
            F.aggregate("assistant_texts", F.lit(0).cast("long"), lambda acc, t: acc + F.length(t)),
        )
        .withColumn("fp", fingerprint())
    )


def record_summary(records: DataFrame) -> DataFrame:
    """One flat row per nested record, the input of ``dataset_stats``."""
    answers = F.filter(F.col("messages"), lambda m: m["role"] == "assistant")
    filled = lambda m: F.coalesce(m["reasoning"], F.lit("")) != ""
    return records.select(
        "seq",
        "kind",
        fingerprint().alias("fp"),
        record_chars().alias("chars"),
        F.when(F.col("kind") == "trace", F.size(answers)).cast("long").alias("assistant_turns"),
        F.when(
            F.col("kind") == "trace",
            F.aggregate(answers, F.lit(0).cast("long"), lambda acc, m: acc + F.length(content_text(m))),
        ).alias("answer_chars"),
        F.coalesce(F.exists("messages", filled), F.lit(False)).alias("has_reasoning"),
        F.coalesce(F.exists("messages", lambda m: F.size(m["tool_calls"]) > 0), F.lit(False)).alias("has_tool_calls"),
        F.coalesce(F.try_element_at("messages", F.lit(1))["role"] == "system", F.lit(False)).alias("has_system"),
        *(F.col(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in _META_TYPES.items()),
    )


_META_TYPES = {"meta_source": "string", "meta_license": "string", "meta_lang": "string", "meta_synthetic": "boolean"}


def suitable_objectives(records: DataFrame) -> DataFrame:
    """One row: the objectives these records can feed, as a comma-separated list."""
    row = records.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("kind") == "image").alias("only_images"),
        F.bool_or(F.col("kind").isin("trace", "completion")).alias("answers"),
        F.bool_or((F.size("chosen") > 0) & (F.size("rejected") > 0)).alias("pairs"),
    )
    names = F.when(F.col("n") == 0, F.array().cast("array<string>")).when(
        F.col("only_images"), F.array(F.lit("sft"))
    ).otherwise(
        F.array_compact(
            F.array(F.lit("cpt"), F.when(F.col("answers"), F.lit("sft")), F.when(F.col("pairs"), F.lit("dpo")))
        )
    )
    return row.select(F.array_join(names, ",").alias("objectives"))


# ---- between the two shapes --------------------------------------------------------------


def explode_turns(records: DataFrame, messages: str = "messages", key: str = "seq", extra: Sequence[str] = ()) -> DataFrame:
    """One row per message with its 0-based ``pos``; no shuffle."""
    return records.select(key, *extra, F.posexplode(messages).alias("pos", "m")).select(
        key, *extra, F.col("pos").cast("long").alias("pos"), "m.*"
    )


def assemble_traces(turns: DataFrame, key: str, order: str, max_turns: int) -> tuple[DataFrame, DataFrame]:
    """``(records, longer)``: nested records for conversations of up to ``max_turns`` turns.

    The turns of longer conversations come back untouched as ``longer``; the turn-table
    operators of this package process those of any length, so nothing is lost.
    """
    sizes = turns.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    short = turns.join(sizes.where(F.col("__n") <= max_turns).select(key), key, "left_semi")
    fields = [c for c in turns.columns if c not in (key, order)]
    records = short.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("m")))), lambda x: x["m"]
        ).alias("messages")
    )
    longer = turns.join(sizes.where(F.col("__n") > max_turns).select(key), key, "left_semi")
    return records, longer


# ---- turn tables -------------------------------------------------------------------------


def turn_summary(turns: DataFrame, key: str = "conv_id", order: str = "turn", content: str = "text") -> DataFrame:
    """One row per conversation: counts, lengths, first/last positions and emptiness."""
    role, text, o = F.col("role"), F.col(content), F.col(order)
    is_a, is_u = role == "assistant", role == "user"
    return turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(is_a).alias("assistant_turns"),
        F.count_if(is_u).alias("user_turns"),
        F.sum(F.length(text)).cast("long").alias("chars"),
        F.coalesce(F.sum(F.when(is_a, F.length(text))), F.lit(0)).cast("long").alias("answer_chars"),
        F.max(F.when(is_a, o)).alias("last_assistant"),
        F.max(F.when(is_u, o)).alias("last_user"),
        F.min(F.when(role != "system", o)).alias("first_body"),
        F.min(o).alias("first_turn"),
        F.max(o).alias("last_turn"),
        F.coalesce(F.min_by(role, o) == "system", F.lit(False)).alias("has_system"),
        F.coalesce(F.bool_or(is_u & is_blank(text)), F.lit(False)).alias("blank_user"),
        F.coalesce(F.max_by(is_blank(text), F.when(is_a, o)), F.lit(True)).alias("blank_answer"),
    ).withColumn("empty", F.col("blank_user") | F.col("blank_answer"))


def turn_fingerprints(turns: DataFrame, key: str = "conv_id", order: str = "turn", content: str = "text") -> DataFrame:
    """``(key, fp)`` from the ordered turns: digests of turns, then of blocks, then of the whole.

    Every collected list is bounded by the block size or by the number of blocks.
    """
    placed = scan_groups(turns.select(key, order, "role", content), [key], order, block_size=BLOCK, position="pos")
    digest = F.md5(F.to_json(F.struct(F.col("role"), strip(F.col(content)).alias("text"))))

    def fold(items: str) -> Column:
        return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["d"]), ""))

    blocks = (
        placed.select(key, F.floor(F.col("pos") / BLOCK).alias("b"), F.struct("pos", digest.alias("d")).alias("x"))
        .groupBy(key, "b")
        .agg(fold("x").alias("d"))
    )
    return blocks.select(key, F.struct("b", "d").alias("x")).groupBy(key).agg(fold("x").alias("fp"))


def turns_without_trailing(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Drop turns after the last assistant turn; conversations without one vanish."""
    scanned = scan_groups(
        turns, [key], order, block_size=BLOCK,
        totals={"__last": ("max", F.when(F.col("role") == "assistant", F.col(order)))},
    )
    return scanned.where(F.col(order) <= F.col("__last")).drop("__last")


def turn_issues(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", content: str = "text", train_on: str = "assistant"
) -> DataFrame:
    """``(key, level, code, index)``: the coded findings of every conversation of a turn table.

    Message errors stop the checks of their conversation, as a broken record cannot be judged
    further; warnings never block. ``index`` is the 0-based position of the turn. A tool turn answers
    the last turn before it that is no tool turn, if that one has ``tool_calls``; a table without that
    column holds no calls, so each of its tool turns is an orphan.
    """
    text = F.col(content)
    calls = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0 if "tool_calls" in turns.columns else F.lit(False)
    canonical = turns.withColumn("__raw", F.col("role")).withColumn("role", canonical_role(F.col("role")))
    role, o = F.col("role"), F.col(order)
    broken = role.isNull() | (is_blank(text) & role.isin("user", "system", "assistant"))
    s = scan_groups(
        canonical.withColumn("__broken", F.coalesce(broken, F.lit(True))),
        [key],
        order,
        block_size=BLOCK,
        position="pos",
        previous={"prev_role": role, "called": F.when(role != "tool", calls)},
        totals={
            "broken": ("max", F.col("__broken").cast("int")),
            "last_assistant": ("max", F.when(role == "assistant", o)),
            "first_body": ("min", F.when(role != "system", o)),
        },
    )
    ok = F.col("broken") == 0
    has_body = F.col("first_body").isNotNull()
    learn = F.col("last_assistant").isNotNull()

    def issue(level: str, code: Column | str, when: Column, index: Column = F.col("pos")) -> Column:
        code = F.lit(code) if isinstance(code, str) else code
        return F.when(when, F.struct(F.lit(level).alias("level"), code.alias("code"), index.cast("int").alias("index")))

    after_last = F.col("last_assistant").isNull() | (o > F.col("last_assistant"))
    lone_system = (role == "system") & (F.col("pos") == 0)
    empty_code = F.when(role == "assistant", F.lit("empty_assistant")).otherwise(F.lit("empty_message"))
    found = F.array_compact(
        F.array(
            issue("error", "bad_role", role.isNull()),
            issue("error", empty_code, role.isNotNull() & F.col("__broken")),
            issue("warning", "empty_tool_result", (role == "tool") & is_blank(text)),
            issue("warning", "system_not_first", ok & (role == "system") & (F.col("pos") > 0)),
            issue("error", "no_messages", ok & ~has_body & (F.col("pos") == 0), F.lit(None)),
            issue("warning", "starts_without_user", ok & (o == F.col("first_body")) & (role != "user")),
            issue("error", "orphan_tool_result", ok & (role == "tool") & ~F.coalesce("called", F.lit(False))),
            issue("warning", "repeated_role", ok & has_body & (role == F.col("prev_role")) & role.isin("user", "assistant")),
            issue("warning", "trailing_messages", ok & has_body & after_last & ~lone_system, F.lit(None)),
            issue("error", "nothing_to_learn", ok & has_body & ~learn & (F.col("pos") == 0), F.lit(None)),
        )
    )
    return s.select(key, F.explode(found).alias("i")).select(key, "i.*")
