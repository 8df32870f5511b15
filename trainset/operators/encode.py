"""Token samples: masked turns, pairs, chunks, packed blocks and padded batches.

Arrays are only assembled after counting has shown that they fit the sample length, so every
collected list is bounded by ``max_len`` tokens or by a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trainset.functions.text import seeded_hash
from trainset.functions.tokens import special_id, token_count, token_ids
from trainset.operators.ordered import hash_bucket, with_hash_position, with_running_total
from trainset.operators.render import Dialect, piece_rows
from trainset.operators.traces import BLOCK
from trainset.schema import IGNORE_INDEX

# Usual lower limits of trainers; nothing is dropped unless they are passed.
MIN_CHUNK = 16  # tokens of a later chunk of a document
MIN_TAIL = 64  # tokens of the last packed block


def masked(ids: Column) -> Column:
    return F.transform(ids, lambda _t: F.lit(IGNORE_INDEX))


def trainable_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE_INDEX)).cast("long")


def labels_of_offsets(ids: Column, starts: Column, ends: Column, spans: Column) -> Column:
    """Labels from token offsets: a token counts if it starts inside a span ``struct<a, b>``."""
    inside = lambda s: F.exists(spans, lambda x: (s >= x["a"]) & (s < x["b"]))
    return F.transform(
        F.arrays_zip(ids.alias("t"), starts.alias("s"), ends.alias("e")),
        lambda z: F.when((z["e"] > z["s"]) & inside(z["s"]), z["t"]).otherwise(F.lit(IGNORE_INDEX)),
    )


def tokenize_with(
    df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[tuple[list[int], list[int], list[int]]]]], batch: int = 256
) -> DataFrame:
    """Tokenise with any tokenizer: ``load()`` runs once per task, the callable maps a batch of
    texts to (ids, start offsets, end offsets). Adds ids, starts, ends."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, ints) for n in ("ids", "starts", "ends")]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch].copy()
                rows = encode(part[text].tolist())
                for n, i in (("ids", 0), ("starts", 1), ("ends", 2)):
                    part[n] = [r[i] for r in rows]
                yield part

    return df.mapInPandas(run, schema)


# ---- conversations ------------------------------------------------------------------------


def turn_token_counts(rendered: DataFrame, key: str = "conv_id") -> DataFrame:
    """Tokens and trainable tokens per conversation, from the pieces."""
    n = lambda flag: F.aggregate(
        "pieces", F.lit(0).cast("long"), lambda a, p: a + F.when(F.lit(not flag) | p["trainable"], token_count(p["piece"])).otherwise(F.lit(0))
    )
    return rendered.groupBy(key).agg(F.sum(n(False)).alias("tokens"), F.sum(n(True)).alias("trainable_tokens"))


def sample_outcomes(counts: DataFrame, max_len: int, overflow: str = "drop", key: str = "conv_id") -> DataFrame:
    """Add ``outcome``: sample, skipped_long or skipped_untrainable."""
    if overflow not in ("drop", "truncate"):
        raise ValueError("overflow must be 'drop' or 'truncate'")
    long_one = (F.col("tokens") > max_len) & F.lit(overflow == "drop")
    return counts.withColumn(
        "outcome",
        F.when(long_one, F.lit("skipped_long")).when(F.col("trainable_tokens") == 0, F.lit("skipped_untrainable")).otherwise(F.lit("sample")),
    )


def encode_sft(rendered: DataFrame, max_len: int, overflow: str = "drop", key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Samples ``(key, input_ids, labels)`` of rendered turns.

    ``drop`` assembles only conversations that fit; ``truncate`` keeps the first ``max_len``
    tokens, found by running totals before anything is collected.
    """
    rows = piece_rows(rendered, key, order).withColumn("n", token_count(F.col("piece")))
    if overflow == "drop":
        fits = sample_outcomes(turn_token_counts(rendered, key), max_len, overflow, key).where("outcome = 'sample'")
        rows = rows.join(fits.select(key), key, "left_semi")
    else:
        rows = with_running_total(rows, ["at", "sub", "from_turn"], F.floor(F.col("at") / BLOCK), "start", F.col("n"), [key])
        rows = rows.where(F.col("start") < max_len)
    ids = token_ids(F.col("piece"))
    if overflow == "truncate":
        ids = F.slice(ids, F.lit(1), F.least(F.col("n"), F.lit(max_len) - F.col("start")).cast("int"))
    rows = rows.withColumn("ids", ids)
    part = F.struct("at", "sub", "from_turn", F.col("ids"), F.when(F.col("trainable"), F.col("ids")).otherwise(masked(F.col("ids"))).alias("labels"))
    joined = rows.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("p"))  # at most max_len tokens
    samples = joined.select(
        key, F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids"), F.flatten(F.transform("p", lambda x: x["labels"])).alias("labels")
    )
    return samples.where(trainable_tokens(F.col("labels")) > 0)


def encode_sft_with(
    rendered: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[list[int], list[int], list[int]]]]], max_len: int,
    overflow: str = "drop", key: str = "conv_id", order: str = "turn", max_token_chars: int | None = None,
) -> DataFrame:
    """Samples ``(key, input_ids, labels)`` with any tokenizer (see ``tokenize_with``).

    A conversation becomes one text with its trainable spans; a token is learned if it starts in one.
    ``max_token_chars`` is the longest token of the vocabulary, if it is known to have one: a text of more than
    ``max_len`` times as many characters cannot fit, so ``drop`` leaves it out, and ``truncate`` cuts it there, before it
    is put together. By default a conversation is put together whole, as long as its record is.
    """
    rows = piece_rows(rendered, key, order).withColumn("n", F.length("piece"))
    rows = with_running_total(rows, ["at", "sub", "from_turn"], F.floor(F.col("at") / BLOCK), "start", F.col("n"), [key], total="chars")
    if max_token_chars is not None:
        most = max_len * max_token_chars
        rows = rows.where(F.col("chars") <= most) if overflow == "drop" else rows.where(F.col("start") < most)
    part = F.array_sort(F.collect_list(F.struct("start", "n", "trainable", "piece")))
    texts = rows.groupBy(key).agg(part.alias("p")).select(
        key, F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"),
        F.transform(F.filter("p", lambda x: x["trainable"]), lambda x: F.struct(x["start"].alias("a"), (x["start"] + x["n"]).alias("b"))).alias("spans"),
    )
    coded = tokenize_with(texts, "text", load)
    coded = coded.where(F.size("ids") <= max_len) if overflow == "drop" else coded
    labels = labels_of_offsets(F.col("ids"), F.col("starts"), F.col("ends"), F.col("spans"))
    samples = coded.select(key, F.slice("ids", 1, max_len).alias("input_ids"), F.slice(labels, 1, max_len).alias("labels"))
    return samples.where(trainable_tokens(F.col("labels")) > 0)


def encode_preferences(
    prompt: DataFrame, chosen: DataFrame, rejected: DataFrame, max_len: int, key: str = "conv_id"
) -> DataFrame:
    """Pairs from per-key token arrays ``ids`` of the prompt and of both alternatives.

    Only the alternatives carry labels. A pair is dropped if either side is too long or empty.
    """
    both = (
        prompt.select(key, F.col("ids").alias("p"))
        .join(chosen.select(key, F.col("ids").alias("c"), F.col("mask").alias("cm")), key)
        .join(rejected.select(key, F.col("ids").alias("r"), F.col("mask").alias("rm")), key)
    )
    return pair_samples(both, "p", "c", "r", max_len, [key])


def pair_samples(df: DataFrame, prompt: str, chosen: str, rejected: str, max_len: int, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs from three token-array columns of one row."""
    p = F.col(prompt)
    fits = lambda a: (F.size(p) + F.size(a) <= max_len) & (F.size(a) > 0)
    kept = df.where(fits(F.col(chosen)) & fits(F.col(rejected)))
    made = {"chosen": F.col(chosen), "rejected": F.col(rejected)}
    return kept.select(
        *keep,
        *[F.concat(p, a).alias(f"{n}_ids") for n, a in made.items()],
        *[F.concat(masked(p), a).alias(f"{n}_labels") for n, a in made.items()],
    )


# ---- text and completions --------------------------------------------------------------------


def marker_count(dialect: Dialect) -> int:
    return int(dialect.document_bos) + int(dialect.document_end is not None)


def marked_ids(text: Column, dialect: Dialect) -> Column:
    """Ids of a text by the built-in tokenizer between its begin and end tokens.

    The tokenizer never yields a special token from text, so the markers are simply added.
    """
    around = [F.array(special_id(dialect.bos))] if dialect.document_bos else []
    after = [F.array(special_id(dialect.document_end))] if dialect.document_end is not None else []
    return F.concat(*around, token_ids(text), *after)


def document_ids(ids: Column, dialect: Dialect) -> Column:
    """Begin and end tokens around the ids of any tokenizer, unless they are there already."""
    if dialect.document_bos:
        bos = special_id(dialect.bos)
        ids = F.when(F.coalesce(F.get(ids, F.lit(0)) == bos, F.lit(False)), ids).otherwise(F.concat(F.array(bos), ids))
    end = special_id(dialect.document_end)
    if dialect.document_end is not None:
        ids = F.when(F.coalesce(F.try_element_at(ids, F.lit(-1)) == end, F.lit(False)), ids).otherwise(F.concat(ids, F.array(end)))
    return ids


def chunk_text(df: DataFrame, ids: str, max_len: int, keep: Sequence[str] = (), min_chunk: int = 0) -> DataFrame:
    """Cut token arrays into chunks of ``max_len``; later chunks below ``min_chunk`` tokens are dropped (see ``chunk_report``).

    The chunks are sliced before the explode, so the document is not copied per chunk.
    """
    n = F.size(ids)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(max_len))).otherwise(F.array().cast("array<int>"))
    chunks = F.filter(
        F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(F.col(ids), s + 1, F.lit(max_len)).alias("input_ids"))),
        lambda c: (c["start"] == 0) | (F.size(c["input_ids"]) >= min_chunk),
    )
    return df.select(*keep, F.inline(chunks)).withColumn("labels", F.col("input_ids"))


def chunk_report(df: DataFrame, n: Column, max_len: int, min_chunk: int = 0) -> DataFrame:
    """One row: documents, tokens, and the chunks and tokens that ``chunk_text`` drops."""
    rest = F.pmod(n.cast("long"), F.lit(max_len).cast("long"))
    short = (n > max_len) & (rest > 0) & (rest < min_chunk)
    return df.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("tokens"),
        F.count_if(short).alias("dropped_chunks"), F.coalesce(F.sum(F.when(short, rest)), F.lit(0)).alias("dropped_tokens"),
    )


def encode_completion(df: DataFrame, prompt: str, completion: str, dialect: Dialect, max_len: int, overflow: str = "drop", keep: Sequence[str] = ()) -> DataFrame:
    """Prompt without loss, completion and end token with loss."""
    p, c = token_ids(F.col(prompt)), token_ids(F.col(completion))
    if dialect.document_bos:
        p = F.concat(F.array(special_id(dialect.bos)), p)
    if dialect.document_end is not None:
        c = F.concat(c, F.array(special_id(dialect.document_end)))
    made = df.select(*keep, p.alias("p"), c.alias("c")).select(
        *keep, F.concat("p", "c").alias("input_ids"), F.concat(masked(F.col("p")), F.col("c")).alias("labels")
    )
    if overflow == "drop":
        made = made.where(F.size("input_ids") <= max_len)
    else:
        made = made.select(*keep, F.slice("input_ids", 1, max_len).alias("input_ids"), F.slice("labels", 1, max_len).alias("labels"))
    return made.where(trainable_tokens(F.col("labels")) > 0)


# ---- packing ------------------------------------------------------------------------------------


def pack(
    df: DataFrame, key: str, n: Column, ids: Column, max_len: int, seed: int = 42, min_tail: int = 0
) -> DataFrame:
    """Concatenate documents in seeded order and cut the stream into blocks: (block, input_ids).

    ``n`` counts the tokens of a row, ``ids`` builds them. Only the counts are needed to give
    every document its place in the stream; the arrays are built behind that shuffle, spread
    over all tasks, and their pieces go straight to their blocks. A block never collects more
    than ``max_len`` tokens. The last block is dropped if it has fewer than ``min_tail`` tokens.
    """
    ordered = df.withColumn("__h", seeded_hash(seed, F.col(key))).withColumn("__n", n.cast("long")).where(F.col("__n") > 0)
    placed = with_running_total(
        ordered, ["__h", key], hash_bucket(F.col("__h")), "start", F.col("__n"), total="stream"
    ).withColumn("__ids", ids)
    first, last = F.floor(F.col("start") / max_len), F.floor((F.col("start") + F.col("__n") - 1) / max_len)
    pieces = F.transform(
        F.sequence(first, last),
        lambda b: F.struct(
            b.alias("block"),
            F.greatest(F.col("start"), b * max_len).alias("at"),
            F.slice(
                F.col("__ids"),
                (F.greatest(b * max_len - F.col("start"), F.lit(0)) + 1).cast("int"),
                (F.least((b + 1) * max_len, F.col("start") + F.col("__n")) - F.greatest(F.col("start"), b * max_len)).cast("int"),
            ).alias("part"),
        ),
    )
    full = (F.col("block") + 1) * max_len <= F.col("stream")
    tail = F.col("stream") - F.col("block") * max_len >= min_tail
    return (
        placed.select("stream", F.inline(pieces))
        .where(full | tail)
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
        .select("block", F.flatten(F.transform("p", lambda x: x["part"])).alias("input_ids"))
    )


# ---- batches --------------------------------------------------------------------------------------


def pad_to(arr: Column, length: Column, value: int) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(value), (length - F.size(arr)).cast("int")))


def assign_batches(df: DataFrame, key: str, batch_size: int, seed: int = 42) -> DataFrame:
    """Add ``batch``: seeded order, ``batch_size`` samples each."""
    placed = with_hash_position(df.withColumn("__h", seeded_hash(seed, F.col(key))), "__h", key, "__pos")
    return placed.withColumn("batch", F.floor(F.col("__pos") / batch_size)).drop("__h", "__pos")


def length_batches(df: DataFrame, length: str, key: str, batch_size: int) -> DataFrame:
    """Add ``batch``: samples of similar length together; the order is (length, hash of key).

    Buckets follow the length; ties are spread by the hash digits, so one frequent length
    does not end up in one task.
    """
    base = df.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__l", F.col(length).cast("long"))
    # Lengths up to 65535 have a bucket each, longer ones 4096 for every doubling: at most 2^17 for 2^31 tokens.
    doubling = F.floor(F.log2(F.col("__l") + F.lit(0.5))).cast("int")
    width = F.pow(F.lit(2.0), doubling - 12).cast("long")
    start = F.pow(F.lit(2.0), doubling).cast("long")
    long_one = F.lit(65536).cast("long") + (doubling - 16) * 4096 + F.floor((F.col("__l") - start) / width)
    coarse = base.withColumn("__all", F.when(F.col("__l") < 65536, F.greatest(F.col("__l"), F.lit(0))).otherwise(long_one))
    # Inside, the exact length and then hash digits: 4096 parts of one frequent length.
    bucket = F.col("__l") * F.lit(4096) + F.conv(F.substring("__h", 1, 3), 16, 10).cast("long")
    totals = coarse.groupBy("__all").agg(F.count(F.lit(1)).alias("__c"))
    from pyspark.sql import Window

    along = Window.orderBy("__all").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^17 rows
    bases = totals.select("__all", F.coalesce(F.sum("__c").over(along), F.lit(0)).alias("__before"))
    inside = with_running_total(coarse.withColumn("__b", bucket), [length, "__h", key], F.col("__b"), "__pos", by=["__all"])
    placed = inside.join(F.broadcast(bases), "__all").withColumn("__pos", F.col("__pos") + F.col("__before"))
    return placed.withColumn("batch", F.floor(F.col("__pos") / batch_size)).drop("__h", "__l", "__all", "__b", "__pos", "__before")


def pad_batches(df: DataFrame, pad_id: int = 0, multiple: int = 8) -> DataFrame:
    """Right-pad input_ids and labels to the batch's longest sample, rounded up; add attention_mask."""
    longest = df.groupBy("batch").agg(F.max(F.size("input_ids")).alias("__max")).withColumn(
        "__len", (F.ceil(F.col("__max") / multiple) * multiple).cast("int")
    )
    padded = df.join(longest, "batch")
    return padded.withColumn(
        "attention_mask", pad_to(F.transform("input_ids", lambda _t: F.lit(1)), F.col("__len"), 0)
    ).withColumn("input_ids", pad_to(F.col("input_ids"), F.col("__len"), pad_id)).withColumn(
        "labels", pad_to(F.col("labels"), F.col("__len"), IGNORE_INDEX)
    ).drop("__max", "__len")


def pad_preference_batches(pairs: DataFrame, key: str, batch_size: int, pad_id: int = 0, seed: int = 42, multiple: int = 8) -> DataFrame:
    """Batches of 2B sequences, chosen first then rejected, in ``row`` order."""
    scores = [c for c in ("ref_chosen", "ref_rejected") if c in pairs.columns]
    batched = assign_batches(pairs, key, batch_size, seed)
    sides = F.array(
        *[
            F.struct(F.lit(i).alias("side"), F.col(f"{n}_ids").alias("input_ids"), F.col(f"{n}_labels").alias("labels"))
            for i, n in enumerate(("chosen", "rejected"))
        ]
    )
    rows = batched.select("batch", key, *scores, F.inline(sides))
    return pad_batches(rows, pad_id, multiple)
