"""Conversations to model text with trainable spans, as Column expressions.

A dialect says how turns are marked. Rendering is local to a turn once its context is known
(neighbouring roles, last user and assistant turn), so conversations of any length render in
parallel: the output has one row per turn with its ordered pieces.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from trainset.functions.text import is_blank, rstrip, text_or_empty
from trainset.operators.ordered import scan_groups, with_running_total, with_running_totals
from trainset.operators.traces import BLOCK
from trainset.schema import TOOL

JSON_FIELDS = ("parameters", "returns", "examples")  # of a tool: JSON kept as text
PIECES = "array<struct<sub:int,piece:string,trainable:boolean>>"

# ---- fixed values: texts that become part of the training data ----
NOTE = "[System note] "
DOCUMENTS_HEAD = "Use the following documents to answer:"
TOOLS_PREAMBLE = (
    "You can call tools. To call one, reply with one or more blocks of the form\n"
    '<tool_call>\n{"name": <tool-name>, "arguments": <json-object>}\n</tool_call>\n'
    "Tool results come back inside <tool_response></tool_response>.\n\nAvailable tools:\n"
)
# --------------------------------------------------------------------


@dataclass(frozen=True)
class Dialect:
    """Turn markers and rendering rules of a model family."""

    name: str
    header: str  # "{role}" is replaced
    turn_end: str
    after_turn: str = "\n"
    assistant_name: str = "assistant"
    tool_name: str = "tool"
    other_ends: tuple[str, ...] = ()
    bos: str = ""
    reasoning: str = "native"  # native | inline | none
    drops_history_reasoning: bool = False
    tools: str = "native"  # native | inline
    strict_alternation: bool = False
    empty_think: str | None = None
    tool_turns_merged: bool = False
    exclude_within_turn: tuple[tuple[str, str], ...] = ()
    max_tool_calls_per_turn: int | None = None
    mid_system: str = "merge"  # native | merge
    document_end: str | None = None
    document_bos: bool = False

    def header_for(self, role: str) -> str:
        return self.header.replace("{role}", {"assistant": self.assistant_name, "tool": self.tool_name}.get(role, role))

    def with_reasoning(self, mode: str) -> "Dialect":
        """Reasoning mode of a run: auto, drop, inline or native."""
        if mode == "native" and self.reasoning != "native":
            raise ValueError(f"{self.name} has no native reasoning format; use 'inline' or 'drop'")
        return {"drop": replace(self, reasoning="none"), "inline": replace(self, reasoning="inline")}.get(mode, self)


# ---- fixed values: published chat markup ----
CHATML = Dialect(
    "chatml", "<|im_start|>{role}\n", "<|im_end|>", empty_think="<think>\n\n</think>\n\n",
    drops_history_reasoning=True, document_end="<|endoftext|>",
)
HEADER_ID = Dialect(
    "header-id", "<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", after_turn="", other_ends=("<|eom_id|>",),
    bos="<|begin_of_text|>", reasoning="inline", max_tool_calls_per_turn=1, tool_name="ipython",
    document_end="<|end_of_text|>", document_bos=True,
)
TURN_TAG = Dialect(
    "turn-tag", "<start_of_turn>{role}\n", "<end_of_turn>", assistant_name="model", bos="<bos>", reasoning="inline",
    tools="inline", strict_alternation=True, document_end="<eos>", document_bos=True,
)
TURN_TAG_MERGED = Dialect(
    "turn-tag-merged", "<|turn>{role}\n", "<turn|>", assistant_name="model", bos="<bos>", tool_turns_merged=True,
    exclude_within_turn=(("<|tool_response>", "<tool_response|>"),), document_end="<eos>", document_bos=True,
)
# ----------------------------------------------


def think_block(reasoning: Column) -> Column:
    return F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n\n"))


def tool_call_blocks(calls: Column) -> Column:
    """Tool calls as tagged JSON, one block per call."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("n"))), r'(?s)^\{"n":(.*)\}$', 1)
    block = lambda c: F.concat(
        F.lit('<tool_call>\n{"name": '), quoted(c["name"]), F.lit(', "arguments": '),
        F.when(c["args_is_object"], c["arguments"]).otherwise(quoted(c["arguments"])), F.lit("}\n</tool_call>"),
    )
    return F.array_join(F.transform(calls, block), "\n")


def with_tool_calls(content: Column, calls: Column) -> Column:
    blocks = tool_call_blocks(calls)
    lead = F.when(is_blank(content), F.lit("")).otherwise(F.concat(rstrip(content), F.lit("\n")))
    return F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, F.concat(lead, blocks)).otherwise(content)


def render_error(dialect: Dialect, calls: Column) -> Column:
    """Why a turn cannot be rendered, NULL if it can."""
    n = F.coalesce(F.size(calls), F.lit(0))
    error = F.lit(None).cast("string")
    if dialect.tools == "native":
        error = F.when(F.exists(calls, lambda c: ~c["args_is_object"]), F.lit("tool call has non-object arguments"))
    if dialect.max_tool_calls_per_turn is not None:
        limit = dialect.max_tool_calls_per_turn
        error = F.when(n > limit, F.lit(f"at most {limit} tool call(s) per assistant turn")).otherwise(error)
    return error


def documents_block(documents: Column) -> Column:
    one = lambda d, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("]"),
        F.when(text_or_empty(d["title"]) != "", F.concat(F.lit(" "), d["title"])).otherwise(F.lit("")), F.lit("\n"), d["text"],
    )
    return F.array_join(F.concat(F.array(F.lit(DOCUMENTS_HEAD)), F.transform(documents, one)), "\n\n")


def tool_json(tool: Column) -> Column:
    """A tool as one JSON object; fields that hold JSON text are spliced in as they are."""
    fields = []
    for f in TOOL.fields:
        value = tool[f.name]
        body = value if f.name in JSON_FIELDS else F.regexp_extract(F.to_json(F.struct(value.alias("n"))), r'(?s)^\{"n":(.*)\}$', 1)
        fields.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{f.name}":'), body)))
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def preamble(documents: Column, tools: Column) -> Column:
    """Documents and tool schemas for the system prompt; NULL if there are neither."""
    docs = F.when(F.size(documents) > 0, documents_block(documents))
    specs = F.when(
        F.size(tools) > 0,
        F.concat(F.lit(TOOLS_PREAMBLE), F.array_join(F.transform(tools, tool_json), "\n")),
    )
    return F.nullif(F.concat_ws("\n\n", docs, specs), F.lit(""))


def with_preamble(first_role: Column, first_text: Column, extra: Column) -> Column:
    """Text of the leading system turn after the preamble was added to it (or became it)."""
    return F.when(extra.isNull(), F.when(first_role == "system", first_text)).otherwise(
        F.when(first_role == "system", F.concat(rstrip(first_text), F.lit("\n\n"), extra)).otherwise(extra)
    )


def exclude_regions(text: Column, regions: Sequence[tuple[str, str]]) -> Column:
    """Split one trained text into pieces; what follows a start marker up to its end marker gets no loss."""
    pieces = F.array(F.struct(text.alias("piece"), F.lit(True).alias("trainable")))
    for start, end in regions:
        pattern = rf"(?s)(?<=\Q{start}\E)(?:.*?\Q{end}\E|.*$)"
        pieces = F.flatten(F.transform(pieces, _cutter(pattern)))
    return pieces


def _cutter(pattern: str):
    def cut(p: Column) -> Column:
        outside = F.split(p["piece"], pattern, -1)
        inside = F.regexp_extract_all(p["piece"], F.lit(pattern), F.lit(0))
        woven = F.flatten(
            F.transform(
                F.arrays_zip(outside.alias("o"), inside.alias("i")),
                lambda z: F.array(
                    F.struct(text_or_empty(z["o"]).alias("piece"), F.lit(True).alias("trainable")),
                    F.struct(text_or_empty(z["i"]).alias("piece"), F.lit(False).alias("trainable")),
                ),
            )
        )
        return F.when(p["trainable"], F.filter(woven, lambda x: x["piece"] != "")).otherwise(F.array(p))

    return cut


def with_context(
    turns: DataFrame, dialect: Dialect, key: str = "conv_id", order: str = "turn", totals: dict[str, tuple[str, Column]] | None = None
) -> DataFrame:
    """Add what rendering one turn needs to know about the others; ``totals`` adds more of the conversation (see ``scan_groups``)."""
    role, o = F.col("role"), F.col(order)
    out_role = F.when((role == "tool") & F.lit(dialect.tools == "inline"), F.lit("user")).otherwise(role)
    if dialect.tool_turns_merged:
        out_role = F.when(role == "tool", F.lit("assistant")).otherwise(out_role)
    shown = out_role if dialect.mid_system == "native" else F.when(role != "system", out_role)
    return scan_groups(
        turns.withColumn("out_role", out_role), [key], order, block_size=BLOCK, position="pos",
        previous={"prev_role": shown}, following={"next_role": shown, "next_user": F.when(role == "user", o)},
        latest={"user_before": F.when(role == "user", o)},
        totals=(totals or {}) | {"last_assistant": ("max", F.when(role == "assistant", o)), "last_user": ("max", F.when(role == "user", o))},
    )


def render_turns(
    turns: DataFrame,
    dialect: Dialect,
    key: str = "conv_id",
    order: str = "turn",
    content: str = "content",
    train_on: str | Column = "assistant",
    history: bool = False,
    forms: bool = False,
    keep: Sequence[str] = (),
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """One row per rendered turn: key, order, at, pos, role, pieces, text, trainable_chars.

    Optional input columns: reasoning, tool_calls, train. ``train_on`` may be a column, the same for a whole
    conversation. Notes from the middle of the conversation move into the next user turn; a note without
    one is dropped. With ``history=True`` every turn is rendered the way it appears *before* a later answer.
    ``keep`` names input columns, ``totals`` columns of the conversation (see ``scan_groups``) to keep.

    ``forms`` adds, where a conversation ``expands`` (see ``expand_samples``), each turn's pieces in three forms:
    ``then`` once a user turn has followed, ``now`` before that, ``answer`` as the last turn of a sample.
    """
    role, o, text = F.col("role"), F.col(order), F.col(content)
    is_a = role == "assistant"
    has_reasoning = "reasoning" in turns.columns and dialect.reasoning != "none"
    reasons = text_or_empty(F.col("reasoning")) != "" if "reasoning" in turns.columns else F.lit(False)
    wanted = dict(totals or {})
    if forms:
        wanted["first_reasoned"] = ("min", F.when(is_a & reasons, o))
    t = with_context(turns, dialect, key, order, wanted)
    if "tool_calls" in turns.columns:
        text = F.when(is_a, with_tool_calls(text, F.col("tool_calls"))).otherwise(text)
    if dialect.tools == "inline":
        text = F.when(role == "tool", F.concat(F.lit("<tool_response>\n"), text, F.lit("\n</tool_response>"))).otherwise(text)
    rule = F.lit(train_on) if isinstance(train_on, str) else train_on
    everything = rule == "all"
    learned = is_a & (F.coalesce(F.col("train"), F.lit(True)) if "train" in turns.columns else F.lit(True))
    same_turn = F.coalesce(o > F.col("last_user"), F.lit(False)) if dialect.strict_alternation else F.lit(False)
    trains = everything | (learned & ((rule != "last") | (o == F.col("last_assistant")) | same_turn))
    mergeable = F.col("out_role").isin("user", "assistant") & F.lit(dialect.strict_alternation) | (
        (F.col("out_role") == "assistant") & F.lit(dialect.tool_turns_merged)
    )
    opens = ~(mergeable & F.coalesce(F.col("prev_role") == F.col("out_role"), F.lit(False)))
    ends = ~(mergeable & F.coalesce(F.col("next_role") == F.col("out_role"), F.lit(False)))
    header = F.lit(dialect.header_for("user"))
    for name in ("system", "assistant", "tool"):
        header = F.when(F.col("out_role") == name, F.lit(dialect.header_for(name))).otherwise(header)
    lead = F.when((F.col("pos") == 0), F.concat(F.lit(dialect.bos), header)).otherwise(header)
    late = (role == "system") & (F.col("pos") > 0) & F.lit(dialect.mid_system == "merge")

    def pieces(current: Column, trains: Column, everything: Column, closes: Column) -> Column:
        """The pieces of a turn; ``current``: no user turn has followed it."""
        thinks = reasons if has_reasoning else F.lit(False)
        shown = thinks & current if (dialect.reasoning == "native" and dialect.drops_history_reasoning) else thinks
        said = F.when(is_a & shown, F.concat(think_block(F.col("reasoning")), text)).otherwise(text) if has_reasoning else text
        body = F.when(closes, said).otherwise(rstrip(said) if dialect.strict_alternation else said)
        body = F.when(is_a & closes, F.concat(body, F.lit(dialect.turn_end))).otherwise(body)
        joint = F.lit("\n\n") if dialect.strict_alternation else F.lit("")
        needs_think = is_a & current & ~thinks & opens & F.lit(bool(dialect.empty_think) and dialect.reasoning == "native")
        own = F.concat(
            F.array(
                _piece(0, F.when(opens, lead).otherwise(joint), everything),
                _piece(2, F.when(needs_think, F.lit(dialect.empty_think or "")).otherwise(F.lit("")), everything),
            ),
            _body_pieces(body, trains, everything, dialect.exclude_within_turn),
            F.array(
                _piece(_LAST, F.when(closes & ~is_a, F.lit(dialect.turn_end)).otherwise(F.lit("")), everything),
                _piece(_LAST + 1, F.when(closes, F.lit(dialect.after_turn)).otherwise(F.lit("")), everything),
            ),
        )
        note = F.array(_piece(1, F.concat(F.lit(NOTE), text, F.lit("\n\n")), everything))
        return F.filter(F.when(late, note).otherwise(own), lambda p: p["piece"] != "")

    current = F.lit(False) if history else (F.col("last_user").isNull() | (o > F.col("last_user")))
    made = {"pieces": pieces(current, trains, everything, ends), "at": F.when(late, F.col("next_user")).otherwise(o)}
    if forms:
        no, yes = F.lit(False), F.lit(True)
        expands = (F.col("first_reasoned") < F.col("last_assistant")) & ~everything & F.lit(has_reasoning and dialect.reasoning == "native" and dialect.drops_history_reasoning)
        made |= {"expands": F.coalesce(expands, no), "answers": learned, "user_before": F.col("user_before")}
        made |= {"then": F.when(expands, pieces(no, no, no, ends)), "now": F.when(expands, pieces(yes, no, no, ends))}
        made |= {"answer": F.when(expands & learned, pieces(yes, learned, no, yes))}
    placed = t.withColumns(made).where(F.col("at").isNotNull())
    return placed.select(
        key, order, "at", "pos", "role", "pieces",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"),
        F.aggregate(
            "pieces", F.lit(0).cast("long"), lambda a, p: a + F.when(p["trainable"], F.length(p["piece"])).otherwise(F.lit(0))
        ).alias("trainable_chars"),
        *keep, *(totals or {}), *([c for c in made if c not in ("pieces", "at")] if forms else []),
    )


_LAST = 1 << 30  # behind all pieces of a body


def _piece(sub: int, body: Column, trainable: Column) -> Column:
    return F.struct(F.lit(sub).alias("sub"), body.alias("piece"), F.coalesce(trainable, F.lit(False)).alias("trainable"))


def _body_pieces(body: Column, trains: Column, everything: Column, excluded: Sequence[tuple[str, str]]) -> Column:
    """A turn's text, cut at the regions that get no loss; learned whole under ``everything``."""
    whole = F.array(_piece(3, body, trains))
    if not excluded:
        return whole
    cut = F.transform(
        exclude_regions(body, excluded),
        lambda p, i: F.struct((i + 3).alias("sub"), p["piece"].alias("piece"), (p["trainable"] & F.coalesce(trains, F.lit(False))).alias("trainable")),
    )
    return F.when(everything, whole).otherwise(cut)


def expand_samples(rendered: DataFrame, now: Column, then: Column, answer: Column, max_len: int, overflow: str = "drop", key: str = "seq", order: str = "turn") -> DataFrame:
    """A sample for each learned answer of conversations that ``expand``: what precedes it, as seen when it was given, and it.

    Dialects that drop earlier reasoning would train only the last answer with its reasoning. So every learned answer of a
    conversation with reasoning before its last answer becomes a sample of its own, in which nothing else is learned:
    turns before the last user turn are in their ``then`` form, those after it in their ``now`` form.

    ``rendered`` comes from ``render_turns(forms=True)``; ``now``, ``then`` and ``answer`` are the tokens of a turn's forms. Running
    totals of both forms give the length of every sample before anything is copied: only answers that fit (``drop``) or begin
    (``truncate``) within ``max_len`` tokens take their history, so a conversation of any length gives at most ``max_len`` samples
    of at most ``max_len`` tokens. Returns rows like ``render_turns``, with ``answer_turn`` beside the key.
    """
    o = F.col(order)
    kept = [c for c in rendered.columns if c not in (key, order, "at", "pieces", "now", "then", "answer")]
    rows, asked = _answers(rendered, now, then, answer, key, order)
    fits = (F.col("__start") + F.col("__own") <= max_len) if overflow == "drop" else (F.col("__start") < max_len)
    asked = asked.where(fits).select(key, o.alias("answer_turn"), F.col("user_before").alias("__user"))
    silent = lambda form: F.transform(form, lambda p: p.withField("trainable", F.lit(False)))
    seen = rows.where(F.col("then_before") < max_len)  # at most max_len rows of a conversation: a turn has a token at least
    shown = seen.join(asked, key).where(F.col("at") <= F.col("answer_turn"))
    form = F.when(o == F.col("answer_turn"), F.col("answer")).when(F.col("at") < F.col("__user"), silent("then")).otherwise(silent("now"))
    return shown.select(key, "answer_turn", order, "at", form.alias("pieces"), *[c for c in kept if c not in ("text", "trainable_chars", "expands", "answers", "user_before", "role", "pos")])


def _answers(rendered: DataFrame, now: Column, then: Column, answer: Column, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The turns with running totals of their forms, and the learned answers with the tokens before them (``__start``)."""
    rows = rendered.where("expands").withColumns({"__now": now, "__then": then, "__own": answer})
    rows = with_running_totals(rows, ["at", order], F.floor(F.col("at") / BLOCK), {"now_before": F.col("__now"), "then_before": F.col("__then")}, [key])
    users = rows.where("role = 'user'").select(key, F.col(order).alias("user_before"), (F.col("then_before") - F.col("now_before")).alias("saved"))
    asked = rows.where("answers").join(users, [key, "user_before"], "left")
    return rows, asked.withColumn("__start", F.col("now_before") + F.coalesce("saved", F.lit(0)))


def answer_lengths(rendered: DataFrame, now: Column, then: Column, answer: Column, key: str = "seq", order: str = "turn") -> DataFrame:
    """The answers that ``expand_samples`` would make samples of at any length, with the ``tokens`` of each; nothing is copied."""
    return _answers(rendered, now, then, answer, key, order)[1].withColumn("tokens", F.col("__start") + F.col("__own"))


def piece_rows(rendered: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Pieces in output order: key, at, sub, note order, piece, trainable."""
    return rendered.select(key, "at", F.col(order).alias("from_turn"), F.inline("pieces"))


def rendered_totals(rendered: DataFrame, key: str = "conv_id") -> DataFrame:
    return rendered.groupBy(key).agg(
        F.sum(F.length("text")).cast("long").alias("chars"), F.sum("trainable_chars").cast("long").alias("trainable_chars")
    )


def preview(rendered: DataFrame, n: int = 2, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Ordered segments of the first ``n`` conversations: the top-k report shown to people."""
    first = rendered.select(key).distinct().orderBy(key).limit(n)
    return piece_rows(rendered.join(F.broadcast(first), key, "left_semi"), key, order)


def expand_turns(
    turns: DataFrame, dialect: Dialect, key: str = "conv_id", order: str = "turn", content: str = "content"
) -> DataFrame:
    """One sample per trainable answer for dialects that drop earlier reasoning.

    A sample is the history up to an answer plus that answer with its reasoning. Its size
    comes from running totals, so nothing is copied: (key, order of the answer, messages,
    chars, trainable_chars). Only conversations with reasoning before their last answer expand.
    """
    plain = render_turns(turns, dialect, key, order, content, history=True)
    sized = with_running_total(
        plain.select(key, order, "pos", "role", F.length("text").alias("hist")),
        [order], F.floor(F.col(order) / BLOCK), "before", weight=F.col("hist"), by=[key],
    )
    reasoned = F.lit(False)
    if "reasoning" in turns.columns:
        last = turns.groupBy(key).agg(
            F.max(F.when(F.col("role") == "assistant", F.col(order))).alias("la"),
            F.min(F.when((F.col("role") == "assistant") & (text_or_empty(F.col("reasoning")) != ""), F.col(order))).alias("fr"),
        ).where(F.col("fr") < F.col("la")).select(key)
        sized = sized.join(last, key, "left_semi")
        reasoned = text_or_empty(F.col("reasoning")) != ""
    answers = turns.where(F.col("role") == "assistant")
    if "train" in turns.columns:
        answers = answers.where(F.coalesce("train", F.lit(True)))
    body = F.concat(F.when(reasoned, think_block(F.col("reasoning") if "reasoning" in turns.columns else F.lit(""))).otherwise(F.lit(dialect.empty_think or "")), F.col(content), F.lit(dialect.turn_end))
    learned = F.length(body) - F.when(~reasoned, F.length(F.lit(dialect.empty_think or ""))).otherwise(F.lit(0))
    own = answers.select(
        key, order, (F.length(F.lit(dialect.header_for("assistant") + dialect.after_turn)) + F.length(body)).alias("own"), learned.alias("learned")
    )
    return sized.join(own, [key, order]).select(
        key, order, (F.col("pos") + 1).alias("messages"), (F.col("before") + F.col("own")).cast("long").alias("chars"),
        F.col("learned").cast("long").alias("trainable_chars"),
    )


def extract_turns(text: Column, dialect: Dialect) -> Column:
    """Assistant turns in already rendered text, without the end marker."""
    ends = "|".join(rf"\Q{e}\E" for e in (dialect.turn_end, *dialect.other_ends))
    return F.regexp_extract_all(text, F.lit(rf"(?s)\Q{dialect.header_for('assistant')}\E(.*?)(?:{ends})"), F.lit(1))
