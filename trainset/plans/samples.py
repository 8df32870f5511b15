"""Training samples of a record table for one objective."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trainset.functions.text import rstrip
from trainset.functions.tokens import special_id, token_count, token_ids
from trainset.operators import encode as E
from trainset.operators.render import Dialect, answer_lengths, expand_samples, piece_rows, preamble, render_error, render_turns
from trainset.operators.sampling import upsample
from trainset.operators.stats import CANDIDATE_LENGTHS, coverage, token_stats, unpivot_metrics
from trainset.operators.traces import content_text, conversation
from trainset.schema import MESSAGE, TOOL
from trainset.session import materialize


def build_text_samples(documents: DataFrame, dialect: Dialect, max_len: int, objective: str = "sft", key: str = "seq", seed: int = 42, min_chunk: int = 0, min_tail: int = 0) -> DataFrame:
    """Text records with a ``repeat`` column: chunks for sft, packed blocks for cpt; any other objective raises."""
    if objective not in ("sft", "cpt"):
        raise ValueError(f"text records make no samples for objective {objective!r}")
    repeated = upsample(documents, F.col("repeat")) if "repeat" in documents.columns else documents.withColumn("copy", F.lit(1))
    rows = repeated.select(F.concat_ws("-", key, "copy").alias("sample"), "text")
    if objective == "cpt":
        n = token_count(F.col("text")) + E.marker_count(dialect)
        return E.pack(rows, "sample", n, E.marked_ids(F.col("text"), dialect), max_len, seed, min_tail)
    coded = rows.select("sample", E.marked_ids(F.col("text"), dialect).alias("ids"))
    return E.chunk_text(coded, "ids", max_len, ["sample"], min_chunk)


def build_turn_samples(turns: DataFrame, dialect: Dialect, max_len: int, overflow: str = "drop", key: str = "conv_id", order: str = "turn", train_on: str = "assistant") -> DataFrame:
    """Conversation turns to masked samples."""
    return E.encode_sft(render_turns(turns, dialect, key, order, train_on=train_on), max_len, overflow, key, order)


def _led(messages: Column, extra: Column) -> Column:
    """The messages with documents and tool schemas in their leading system turn."""
    first = F.get(messages, F.lit(0))
    own = F.when(first["role"] == "system", F.concat(rstrip(content_text(first)), F.lit("\n\n"), extra)).otherwise(extra)
    fields = [F.lit("system").alias("role"), own.alias("content")]
    fields += [F.lit(None).cast(f.dataType).alias(f.name) for f in MESSAGE.fields[2:]]
    rest = F.when(first["role"] == "system", F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    lead = F.array(F.struct(*fields)).cast(f"array<{MESSAGE.simpleString()}>")
    return F.when(extra.isNull(), messages).otherwise(F.concat(lead, rest))


def turns_of_records(records: DataFrame, key: str = "seq", alternative: str | None = None) -> DataFrame:
    """Turns of canonical conversation records: key, turn, role, content, reasoning, tool_calls, train, train_on, repeat.

    Tools and documents become text of the leading system turn. With ``alternative`` (``chosen`` or
    ``rejected``) the turns of that answer follow the messages and nothing else is learned; else a
    preferred answer simply continues its record.
    """
    plain = f"array<{MESSAGE.simpleString()}>"
    messages = F.col("messages").cast(plain)
    if alternative:
        shown = F.concat(F.transform(messages, lambda m: m.withField("train", F.lit(False))), F.col(alternative).cast(plain))
    else:
        shown = conversation(messages, F.col("chosen").cast(plain)) if "chosen" in records.columns else messages
    extra = preamble(*(F.col(c) if c in records.columns else F.lit(None).cast(f"array<{t}>") for c, t in _LEAD_TYPES.items()))
    rule = F.coalesce("train_on", F.lit("assistant")) if "train_on" in records.columns and not alternative else F.lit("assistant")
    rows = records.where("kind = 'trace'").select(key, rule.alias("train_on"), _times(records).alias("repeat"), F.posexplode(_led(shown, extra)).alias("turn", "m"))
    learned = F.coalesce("m.train", F.lit(True)) & (F.coalesce("m.weight", F.lit(1.0)) > 0)
    return rows.select(
        key, "turn", "train_on", "repeat", "m.role", content_text(F.col("m")).alias("content"), "m.reasoning", "m.tool_calls", learned.alias("train")
    )


_LEAD_TYPES = {"documents": "struct<text:string,title:string>", "tools": TOOL.simpleString()}


def _fault(turns: DataFrame, dialect: Dialect) -> Column:
    """Why a dialect cannot show a turn; NULL if it can."""
    silent = F.when((F.col("role") == "user") & (F.trim("content") == ""), F.lit("user turn without text"))
    return F.coalesce(F.when(F.col("role") == "assistant", render_error(dialect, F.col("tool_calls"))), silent)


def _rendered(turns: DataFrame, dialect: Dialect, key: str, forms: bool = False) -> DataFrame:
    """Rendered turns, each conversation under its own ``train_on``, with its ``repeat`` and its first ``fault``."""
    told = turns.withColumn("__fault", _fault(turns, dialect))
    first = F.when(F.col("__fault").isNotNull(), F.struct("turn", F.col("__fault").alias("reason")))
    return render_turns(
        told, dialect, key, "turn", train_on=F.coalesce(F.col("train_on"), F.lit("assistant")), forms=forms, keep=["repeat"], totals={"fault": ("min", first)}
    )


def render_records(turns: DataFrame, dialect: Dialect, key: str = "seq") -> DataFrame:
    """Rendered turns of all conversations that can be shown, each under its own ``train_on``, with its ``repeat``."""
    return _rendered(turns, dialect, key).where("fault IS NULL").drop("fault")


def _tokens(form: str) -> Column:
    return F.coalesce(F.aggregate(form, F.lit(0).cast("long"), lambda a, p: a + token_count(p["piece"])), F.lit(0))


def _form_tokens(rendered: DataFrame, tokenizer) -> tuple[DataFrame, list[Column]]:
    """Tokens of each turn's forms. With a plugged-in tokenizer notes, which go into another turn, count nothing:
    a bound from below, which the samples themselves are checked against."""
    names = ["now", "then", "answer"]
    if tokenizer is None:
        return rendered, [_tokens(n) for n in names]
    for n in names:
        text = F.when((F.col("at") != F.col("turn")) | F.col(n).isNull(), F.lit("")).otherwise(F.array_join(F.transform(n, lambda p: p["piece"]), ""))
        rendered = _tokenized(rendered, text, tokenizer, f"__ids_{n}").withColumn(f"__n_{n}", F.size(f"__ids_{n}")).drop(f"__ids_{n}")
    return rendered, [F.col(f"__n_{n}") for n in names]


def conversation_rows(turns: DataFrame, dialect: Dialect, max_len: int, overflow: str, key: str, tokenizer=None, expand: bool = True) -> DataFrame:
    """Rendered turns of every sample to be: ``sample`` (key, answer_turn, repeat), turn, at, pieces.

    Rendered once and written, as samples of one answer each and whole conversations both branch off it.
    """
    drops = expand and dialect.drops_history_reasoning and dialect.reasoning == "native"
    rendered = _rendered(turns, dialect, key, forms=drops).where("fault IS NULL").drop("fault")
    sample = lambda answer: F.struct(F.col(key).alias("key"), answer.cast("int").alias("answer_turn"), "repeat").alias("sample")
    columns = ("turn", "at", "pieces")
    if not drops:
        return rendered.select(sample(F.lit(None)), *columns)
    written = materialize(rendered, "rendered")
    counted, (now, then, answer) = _form_tokens(written.where("expands"), tokenizer)
    single = expand_samples(counted, now, then, answer, max_len, overflow, key)
    whole = written.where(~F.col("expands")).select(sample(F.lit(None)), *columns)
    return whole.unionByName(single.select(sample(F.col("answer_turn")), *columns))


def _kind(records: DataFrame, kind: str, key: str, *columns: str) -> DataFrame | None:
    """Key, repeat and text columns of the records of a kind; None if the table has no such columns."""
    if not set(columns) <= set(records.columns):
        return None
    return records.where(F.col("kind") == kind).select(key, _times(records).alias("repeat"), *(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def _times(records: DataFrame) -> Column:
    return F.greatest(F.coalesce(F.col("repeat").cast("int"), F.lit(1)), F.lit(1)) if "repeat" in records.columns else F.lit(1)


def _copied(made: DataFrame, key: str) -> DataFrame:
    """Each sample as often as its record repeats: (key, copy, ...)."""
    columns = [c for c in made.columns if c not in (key, "repeat")]
    return upsample(made, F.col("repeat")).select(key, "copy", *columns)


def _tokenized(rows: DataFrame, text: Column, tokenizer, ids: str) -> DataFrame:
    coded = E.tokenize_with(rows.withColumn("__text", text), "__text", tokenizer)
    return coded.drop("__text", "starts", "ends").withColumnRenamed("ids", ids)


def _marked_text(text: Column, dialect: Dialect, begin: Column) -> Column:
    """The text between its markers as a plugged-in tokenizer reads them, unless they are there already."""
    if dialect.document_bos:
        text = F.when(begin & ~F.startswith(text, F.lit(dialect.bos)), F.concat(F.lit(dialect.bos), text)).otherwise(text)
    if dialect.document_end is not None:
        text = F.when(F.endswith(text, F.lit(dialect.document_end)), text).otherwise(F.concat(text, F.lit(dialect.document_end)))
    return text


def _text_chunks(rows: DataFrame, dialect: Dialect, max_len: int, key: str, tokenizer) -> DataFrame:
    if tokenizer is None:
        coded = rows.withColumn("ids", E.marked_ids(F.col("text"), dialect))
    else:
        coded = _tokenized(rows, _marked_text(F.col("text"), dialect, F.lit(True)), tokenizer, "ids")
    return E.chunk_text(coded, "ids", max_len, [key, "repeat"])


def _completions(rows: DataFrame, dialect: Dialect, max_len: int, overflow: str, key: str, tokenizer) -> DataFrame:
    if tokenizer is None:
        return E.encode_completion(rows, "prompt", "completion", dialect, max_len, overflow, [key, "repeat"])
    begin, end = F.lit(dialect.bos if dialect.document_bos else ""), F.lit(dialect.document_end or "")
    coded = _tokenized(rows, F.concat(begin, F.col("prompt")), tokenizer, "p")
    coded = _tokenized(coded, F.concat(F.col("completion"), end), tokenizer, "c")
    made = coded.select(key, "repeat", F.concat("p", "c").alias("input_ids"), F.concat(E.masked(F.col("p")), F.col("c")).alias("labels"))
    made = made.where(F.size("input_ids") <= max_len) if overflow == "drop" else made
    made = made.withColumns({c: F.slice(c, 1, max_len) for c in ("input_ids", "labels")})
    return made.where(E.trainable_tokens(F.col("labels")) > 0)


def _documents(records: DataFrame, dialect: Dialect, key: str) -> DataFrame:
    """Every record as raw text: (key, repeat, text, rendered). A conversation's text is as bounded as its record."""
    made = []
    if (texts := _kind(records, "text", key, "text")) is not None:
        made.append(texts.withColumn("rendered", F.lit(False)))
    if (pairs := _kind(records, "completion", key, "prompt", "completion")) is not None:
        made.append(pairs.select(key, "repeat", F.concat("prompt", "completion").alias("text"), F.lit(False).alias("rendered")))
    if "messages" in records.columns:
        turns = turns_of_records(records.withColumn("train_on", F.lit("all")), key)
        rendered = render_records(turns, dialect, key).withColumn("sample", F.struct(key, "repeat"))
        made.append(sample_texts(rendered, "sample").select(f"sample.{key}", "sample.repeat", "text", F.lit(True).alias("rendered")))
    return reduce(DataFrame.unionByName, made) if made else _nothing(records, key).select(key, F.lit(1).alias("repeat"), F.lit("").alias("text"), F.lit(False).alias("rendered"))


def _nothing(records: DataFrame, key: str) -> DataFrame:
    return records.where(F.lit(False)).select(key)


def _pairs(records: DataFrame) -> Column:
    """Preference records: both answers are there."""
    if not {"chosen", "rejected"} <= set(records.columns):
        return F.lit(False)
    return F.coalesce((F.col("kind") == "trace") & (F.size("chosen") > 0) & (F.size("rejected") > 0), F.lit(False))


def build_samples(records: DataFrame, dialect: Dialect, objective: str, max_len: int, overflow: str = "drop", key: str = "seq", seed: int = 42, tokenizer=None, expand: bool = True) -> DataFrame:
    """Training samples of canonical records, ``repeat`` copies of each; what is left out is counted by ``build_report``.

    ``tokenizer`` loads any tokenizer (see ``encode.tokenize_with``), which must read the dialect's markers
    as tokens of their own; the built-in one is for counting and tests. ``key`` is unique.

    - ``sft``: conversations, prompts with completions, chunks of texts: (key, copy, answer_turn, start, input_ids, labels).
      A conversation of a dialect that drops earlier reasoning gives a sample for each learned answer, at ``answer_turn``, if there
      is reasoning before its last answer (``expand=False``: never); ``start`` is a chunk's first token in its text, else 0
    - ``cpt``: texts, prompts joined with completions, conversations rendered whole: packed blocks (block, input_ids)
    - ``dpo``: preference records, (key, copy, chosen_ids, chosen_labels, rejected_ids, rejected_labels)

    Images make no samples of tokens; a table of nothing else gives no rows.
    """
    def encode(turns: DataFrame, expand: bool) -> DataFrame:
        rendered = conversation_rows(turns, dialect, max_len, overflow, key, tokenizer, expand)
        if tokenizer is None:
            made = E.encode_sft(rendered, max_len, overflow, "sample", "turn")
        else:
            made = E.encode_sft_with(rendered, tokenizer, max_len, overflow, "sample", "turn")
        return made.select(F.col("sample.key").alias(key), "sample.answer_turn", "sample.repeat", "input_ids", "labels")

    if objective == "sft":
        columns = (key, "copy", "answer_turn", "start", "input_ids", "labels")
        whole = {"answer_turn": F.lit(None).cast("int"), "start": F.lit(0)}
        made = []
        if "messages" in records.columns:
            made.append(encode(turns_of_records(records, key), expand).withColumn("start", F.lit(0)))
        if (pairs := _kind(records, "completion", key, "prompt", "completion")) is not None:
            made.append(_completions(pairs, dialect, max_len, overflow, key, tokenizer).withColumns(whole))
        if (texts := _kind(records, "text", key, "text")) is not None:
            made.append(_text_chunks(texts, dialect, max_len, key, tokenizer).withColumn("answer_turn", whole["answer_turn"]))
        none = F.array().cast("array<int>")
        made = made or [_nothing(records, key).withColumns(whole | {"repeat": F.lit(1), "input_ids": none, "labels": none})]
        return reduce(DataFrame.unionByName, [_copied(m, key).select(*columns) for m in made])
    if objective == "cpt":
        rows = _documents(records, dialect, key)
        if tokenizer is None:
            begin = F.when(F.col("rendered"), F.array().cast("array<int>")).otherwise(F.array(special_id(dialect.bos)))
            around = [begin] if dialect.document_bos else []
            after = [F.array(special_id(dialect.document_end))] if dialect.document_end is not None else []
            ids = F.concat(*around, token_ids(F.col("text")), *after)
            n = token_count(F.col("text")) + E.marker_count(dialect) - F.when(F.col("rendered"), F.lit(int(dialect.document_bos))).otherwise(F.lit(0))
        else:
            rows = _tokenized(rows, _marked_text(F.col("text"), dialect, ~F.col("rendered")), tokenizer, "ids")
            ids, n = F.col("ids"), F.size("ids")
        rows = upsample(rows, F.col("repeat")).withColumn("sample", F.concat_ws("-", key, "copy"))
        return E.pack(rows, "sample", n, ids, max_len, seed)
    if objective == "dpo":
        if not {"chosen", "rejected", "messages"} <= set(records.columns):
            none = F.array().cast("array<int>")
            return _nothing(records, key).select(key, F.lit(1).alias("copy"), *(none.alias(f"{s}_{c}") for s in ("chosen", "rejected") for c in ("ids", "labels")))
        pairs = records.where(_pairs(records))
        sides = [
            encode(turns_of_records(pairs, key, side), False).select(
                key, *(["repeat"] if side == "chosen" else []), F.col("input_ids").alias(f"{side}_ids"), F.col("labels").alias(f"{side}_labels")
            )
            for side in ("chosen", "rejected")
        ]
        return _copied(sides[0].join(sides[1], key), key)  # a pair needs both
    raise ValueError(f"no samples are known for objective {objective!r}")


def _judged(turns: DataFrame, dialect: Dialect, max_len: int, overflow: str, key: str, expand: bool = False) -> DataFrame:
    """(key, outcome, reason) of conversations; one that gives a sample for each answer is a sample if any of them is."""
    failed = _rendered(turns, dialect, key).where("fault IS NOT NULL").groupBy(key).agg(F.first("fault.reason").alias("reason"))
    rows = conversation_rows(turns, dialect, max_len, overflow, key, expand=expand)
    if overflow == "truncate":  # what is learned may lie behind the cut
        made = E.encode_sft(rows, max_len, overflow, "sample", "turn")
    else:
        made = E.sample_outcomes(E.turn_token_counts(rows, "sample"), max_len, overflow, "sample").where("outcome = 'sample'")
    made = made.select(F.col("sample.key").alias(key)).distinct().withColumn("outcome", F.lit("sample"))
    # Of the others: too long, if anything could be learned
    learned = F.max(F.coalesce(F.col("role") == "assistant", F.lit(False)) & F.coalesce("train", F.lit(True)) | (F.col("train_on") == "all")).alias("learned")
    every = turns.groupBy(key).agg(learned)
    rest = F.when(F.col("learned") & F.lit(overflow == "drop"), F.lit("skipped_long")).otherwise(F.lit("skipped_untrainable"))
    told = every.join(failed, key, "left").join(made, key, "left")
    outcome = F.when(F.col("reason").isNotNull(), F.lit("unrenderable")).otherwise(F.coalesce("outcome", rest))
    return told.select(key, outcome.alias("outcome"), "reason")


def build_report(records: DataFrame, dialect: Dialect, max_len: int, overflow: str = "drop", key: str = "seq", objective: str = "sft") -> DataFrame:
    """(outcome, reason, n): what becomes of every record of a table under an objective, counted ``repeat`` times.

    Outcomes are sample, unrenderable (with the reason), skipped_long, skipped_untrainable and, under ``dpo``,
    not_preference. Tokens are those of the built-in tokenizer.
    """
    if objective not in ("sft", "cpt", "dpo"):
        raise ValueError(f"no samples are known for objective {objective!r}")
    plain = lambda c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("")
    size = token_count(plain("text")) + E.marker_count(dialect)
    p = token_count(plain("prompt")) + int(dialect.document_bos)
    c = token_count(plain("completion")) + int(dialect.document_end is not None)
    some = lambda n: F.when(n > 0, F.lit("sample")).otherwise(F.lit("skipped_untrainable"))
    kind, turns = F.col("kind"), "messages" in records.columns
    judged, own = None, F.when(kind == "text", some(size))
    if objective == "sft":
        untrained = (c == 0) | (p >= max_len) if overflow == "truncate" else c == 0
        long_one = (p + c > max_len) & F.lit(overflow == "drop")
        own = own.when(kind == "completion", F.when(long_one, F.lit("skipped_long")).when(untrained, F.lit("skipped_untrainable")).otherwise(F.lit("sample")))
        judged = _judged(turns_of_records(records, key), dialect, max_len, overflow, key, True) if turns else None
    elif objective == "cpt":
        own = own.when(kind == "completion", some(p + c))
        if turns:
            seen = turns_of_records(records.withColumn("train_on", F.lit("all")), key)
            fault = F.min(F.when(F.col("__f").isNotNull(), F.struct("turn", F.col("__f").alias("reason")))).alias("f")
            judged = seen.withColumn("__f", _fault(seen, dialect)).groupBy(key).agg(fault).select(key, F.col("f.reason").alias("reason"))
            judged = judged.withColumn("outcome", F.when(F.col("reason").isNotNull(), F.lit("unrenderable")).otherwise(F.lit("sample")))
    else:
        pairs = records.where(_pairs(records))
        own = F.when(~_pairs(records), F.lit("not_preference"))
        sides = [_judged(turns_of_records(pairs, key, side), dialect, max_len, overflow, key) for side in ("chosen", "rejected") if {side, "messages"} <= set(records.columns)]
        worst = F.struct(F.array_position(F.array(*map(F.lit, ("unrenderable", "skipped_long", "skipped_untrainable", "sample"))), F.col("outcome")).alias("rank"), "outcome", "reason")
        judged = reduce(DataFrame.unionByName, sides).groupBy(key).agg(F.min(worst).alias("w")).select(key, "w.outcome", "w.reason") if sides else None
    rest = F.when(kind == "trace", F.lit("skipped_untrainable")).otherwise(F.lit("unrenderable"))  # a trace without turns, or no tokens at all
    why = F.when(own.isNull() & ~F.coalesce(kind == "trace", F.lit(False)), F.concat(F.coalesce(kind, F.lit("unknown")), F.lit(" records make no samples of tokens")))
    rows = records.select(key, _times(records).alias("repeat"), own.alias("own"), rest.alias("rest"), why.alias("why"))
    if judged is not None:
        rows = rows.join(judged.select(key, "outcome", "reason"), key, "left")
    else:
        rows = rows.withColumns({"outcome": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    told = rows.select(F.coalesce("own", "outcome", "rest").alias("outcome"), F.coalesce("reason", "why").alias("reason"), "repeat")
    return told.groupBy("outcome", "reason").agg(F.sum("repeat").cast("long").alias("n"))


def _lengths(records: DataFrame, dialect: Dialect, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(repeat, tokens, trainable_tokens) of all samples under no limit of length, and (reason, repeat) of what cannot be shown."""
    columns = ("repeat", "tokens", "trainable_tokens")
    made, failed = [], None
    if "messages" in records.columns:
        drops = dialect.drops_history_reasoning and dialect.reasoning == "native"
        written = materialize(_rendered(turns_of_records(records, key), dialect, key, forms=drops), "rendered")
        failed = written.where("fault IS NOT NULL").groupBy(key, "repeat").agg(F.first("fault.reason").alias("reason")).select("reason", "repeat")
        shown = written.where("fault IS NULL").drop("fault")
        if drops:
            learned = F.aggregate("answer", F.lit(0).cast("long"), lambda a, p: a + F.when(p["trainable"], token_count(p["piece"])).otherwise(F.lit(0)))
            made.append(answer_lengths(shown, *map(_tokens, ("now", "then", "answer")), key).withColumn("trainable_tokens", learned).select(*columns))
            shown = shown.where(~F.col("expands"))
        whole = E.turn_token_counts(shown.select(F.struct(key, "repeat").alias("sample"), "pieces"), "sample")
        made.append(whole.select("sample.repeat", "tokens", "trainable_tokens"))
    if (pairs := _kind(records, "completion", key, "prompt", "completion")) is not None:
        prompt = token_count(F.col("prompt")) + int(dialect.document_bos)
        answer = token_count(F.col("completion")) + int(dialect.document_end is not None)
        made.append(pairs.select("repeat", (prompt + answer).alias("tokens"), answer.alias("trainable_tokens")))
    if (texts := _kind(records, "text", key, "text")) is not None:
        size = token_count(F.col("text")) + E.marker_count(dialect)
        made.append(texts.select("repeat", size.alias("tokens"), size.alias("trainable_tokens")))
    made = made or [_nothing(records, key).select(*(F.lit(0).alias(c) for c in columns))]
    as_long = [F.col(c).cast("long") for c in columns]
    return reduce(DataFrame.unionAll, [m.select(*as_long) for m in made]).where("trainable_tokens > 0"), failed


def token_report(records: DataFrame, dialect: Dialect, max_len: int | None = None, key: str = "seq", candidates=CANDIDATE_LENGTHS, k: int = 5) -> DataFrame:
    """(part, name, value): what the samples of a table measure if rendered as training renders them.

    ``tokens``: number, total, mean and percentiles of their tokens, the mean of the trainable ones and, with ``max_len``,
    how many are longer; ``coverage``: the share that fits each candidate length; ``failure``: the ``k`` most frequent reasons why
    records cannot be rendered, ties by reason. Records count ``repeat`` times. All records are measured, by counts: no
    sample is assembled. Tokens are those of the built-in tokenizer. A table without samples has the number 0 and no percentiles.
    """
    lengths, failed = _lengths(records, dialect, key)
    rows = materialize(upsample(lengths, F.col("repeat")).select("tokens", "trainable_tokens"), "sample-lengths")
    size = rows.agg(F.count(F.lit(1)).alias("samples"), F.bround(F.avg("trainable_tokens")).alias("trainable_mean"))
    stats = token_stats(rows, max_len=max_len).withColumnRenamed("n", "counted")
    named = lambda df, part: df.select(F.lit(part).alias("part"), F.col("metric").alias("name"), "value")
    out = named(unpivot_metrics(size), "tokens").unionAll(named(unpivot_metrics(stats.drop("counted")), "tokens"))
    fits = coverage(rows, candidates=candidates).select(F.lit("coverage").alias("part"), F.col("max_len").cast("string").alias("name"), F.col("share").cast("double").alias("value"))
    out = out.unionAll(fits)
    if failed is not None:
        reasons = failed.groupBy("reason").agg(F.sum("repeat").alias("n")).orderBy(F.desc("n"), "reason").limit(k)
        out = out.unionAll(reasons.select(F.lit("failure").alias("part"), F.col("reason").alias("name"), F.col("n").cast("double").alias("value")))
    return out.where("value IS NOT NULL")


def sample_texts(rendered: DataFrame, key: str = "seq", order: str = "turn") -> DataFrame:
    """(key, text, learned): a rendered conversation, and what of it is learned; for conversations of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("at", "sub", "from_turn", "piece", "trainable")))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x["piece"]), "")
    whole = piece_rows(rendered, key, order).groupBy(key).agg(parts.alias("p"))
    return whole.select(key, text(F.col("p")).alias("text"), text(F.filter("p", lambda x: x["trainable"])).alias("learned"))


def sample_report(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.size("input_ids")).cast("long").alias("tokens"),
        F.sum(E.trainable_tokens(F.col("labels")) if "labels" in samples.columns else F.size("input_ids")).cast("long").alias("trainable_tokens"),
    )
