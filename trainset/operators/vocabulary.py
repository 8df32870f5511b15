"""A dense vocabulary of a corpus, and texts coded with it.

Ids follow frequency: special tokens first, then every token by falling count, ties in the order of
md5(token). They are gapless and no two tokens share one, so they can index an embedding matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from trainset.functions.tokens import token_strings
from trainset.operators.ordered import hash_bucket, range_bucket, with_running_total
from trainset.session import materialize

UNKNOWN = "<unk>"
HOT_TOKENS = 4096  # rows of the broadcast part of a vocabulary
BLOCK_TOKENS = 4096  # ids in one row of coded text
GROUP_TOKENS = 1 << 22  # tokens that share a list of distinct ones
_POSITION_BITS = 13  # a position in a block (below 8192) ...
_ID_BITS = 40  # ... and an id share one long


def build_vocabulary(
    df: DataFrame, text: str = "text", min_count: int = 1, specials: Sequence[str] = (UNKNOWN,), tokens: Column | None = None
) -> DataFrame:
    """(token, n, id): every token seen ``min_count`` times or more; ``specials`` take the first ids.

    Null texts have no tokens. A token that is spelled like a special keeps that special's id only.
    ``tokens`` replaces the built-in tokenizer by any column of token arrays.

    Counts combine on the map side. The ranks need no global sort: a bucket is one count and one range
    of hashes, so the many tokens of count 1 spread over up to 65536 buckets; only the narrow table of
    buckets takes running totals. The counts are written once.
    """
    spark = df.sparkSession
    words = df.select(F.explode(token_strings(F.col(text)) if tokens is None else tokens).alias("token"))
    counted = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("token").isNotNull() & (F.col("n") >= min_count))
    if specials:
        counted = counted.where(~F.col("token").isin(list(specials)))
    order = F.md5(F.col("token").cast("binary"))
    counts = materialize(counted.withColumns({"order": order, "bucket": hash_bucket(order)}), "token-counts")
    buckets = counts.groupBy("n", "bucket").agg(F.count(F.lit(1)).alias("held")).withColumn("down", -F.col("n"))
    buckets = materialize(buckets, "token-buckets")
    bases = with_running_total(buckets, ["down", "bucket"], range_bucket(buckets, "down"), "base", F.col("held"))
    inside = F.row_number().over(Window.partitionBy("n", "bucket").orderBy("order", "token"))
    ranked = counts.join(bases.select("n", "bucket", "base"), ["n", "bucket"]).select(
        "token", "n", (F.col("base") + inside - 1 + len(specials)).cast("long").alias("id")
    )
    if not specials:
        return ranked
    first = spark.createDataFrame([(t, 0, i) for i, t in enumerate(specials)], ranked.schema)
    return first.unionByName(ranked)


def encode_with_vocabulary(
    df: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", unknown: int = 0, block_tokens: int = BLOCK_TOKENS,
    hot: int = HOT_TOKENS, tokens: Column | None = None,
) -> DataFrame:
    """(key, block, ids): each text's ids in rows of ``block_tokens``; a text without tokens gives one empty row.

    ``key`` should be unique; blocks of texts that share one are put together by position. Tokens outside the
    vocabulary become ``unknown``. Texts are tokenized once and written in groups of at most GROUP_TOKENS tokens (one
    block at least), each token as its place in the group's list of distinct tokens. Only these lists meet the
    vocabulary, so a token is moved once a group, however often it occurs there. Tokens with an id below ``hot`` meet a
    broadcast table of at most ``hot`` rows, the others are joined on the token.
    """
    if not 0 < block_tokens <= 2**_POSITION_BITS:
        raise ValueError(f"block_tokens must lie between 1 and {2**_POSITION_BITS}")
    words = F.coalesce(token_strings(F.col(text)) if tokens is None else tokens, F.array().cast("array<string>"))
    listed = df.select(F.col(key).alias("key"), words.alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(block_tokens))
    blocks = listed.select("key", F.posexplode(starts).alias("block", "start"), "words").select(
        "key", "block", F.slice("words", F.col("start") + 1, block_tokens).alias("words")
    )
    kind = blocks.schema["key"].dataType
    coded = T.StructType().add("group", "long").add("key", kind).add("block", "integer")
    coded = coded.add("codes", T.ArrayType(T.IntegerType())).add("first", "integer").add("fresh", T.ArrayType(T.StringType()))
    groups = materialize(blocks.mapInArrow(_grouped, coded), "token-groups")

    asked = groups.select("group", "first", F.posexplode("fresh").alias("at", "token"))
    asked = asked.select("group", (F.col("first") + F.col("at")).alias("place"), "token")
    lookup = vocabulary.select("token", "id")
    known = asked.join(F.broadcast(lookup.where(F.col("id") < hot)), "token", "left")
    met = known.where(F.col("id").isNull()).drop("id").join(lookup.where(F.col("id") >= hot), "token")
    found = known.where(F.col("id").isNotNull()).unionByName(met).select("group", "place", "id")
    answer = T.StructType().add("key", kind).add("block", "integer").add("ids", T.ArrayType(T.LongType()))
    held = groups.select(F.col("group").alias("held"), "key", "block", "codes").groupBy("held")
    rows = held.cogroup(found.groupBy("group")).applyInArrow(lambda left, right: _decoded(left, right, unknown), answer)

    repeated = groups.where("block = 0").groupBy("key").count().where("count > 1")
    if not repeated.isEmpty():
        placed = F.transform("ids", lambda t, i: F.shiftleft(i.cast("long"), _ID_BITS).bitwiseOR(t))
        cells = F.sort_array(F.flatten(F.collect_list(placed)))
        rows = rows.groupBy("key", "block").agg(F.transform(cells, lambda c: c.bitwiseAND(2**_ID_BITS - 1)).alias("ids"))
    return rows.withColumnRenamed("key", key)


def _grouped(batches: Iterator[pa.RecordBatch], most: int = GROUP_TOKENS) -> Iterator[pa.RecordBatch]:
    """Blocks (key, block, words) with their group, their words' places in its list of distinct tokens, and the
    part of that list, from place ``first`` on, which they are the first to hold."""
    group = TaskContext.get().partitionId() << 33
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64))
        start = before = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
            rows = batch.slice(start, stop - start)
            coded = rows.column(2).flatten().dictionary_encode(null_encoding="encode")
            bounds = np.append(0, ends[start:stop] - before)
            seen = np.maximum.accumulate(np.append(0, coded.indices.to_numpy() + 1))[bounds]
            codes = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), coded.indices)
            fresh = pa.ListArray.from_arrays(pa.array(seen, pa.int32()), coded.dictionary)
            columns = [pa.repeat(pa.scalar(group, pa.int64()), len(codes)), rows.column(0), rows.column(1), codes, pa.array(seen[:-1], pa.int32()), fresh]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "key", "block", "codes", "first", "fresh"])
            group, start, before = group + 1, stop, int(ends[stop - 1])


def _decoded(blocks: pa.Table, found: pa.Table, unknown: int) -> pa.Table:
    """(key, block, ids) of a group's blocks, by the (place, id) of its tokens in the vocabulary."""
    codes = blocks.column("codes").combine_chunks()
    ids = np.full(int(codes.flatten().to_numpy().max(initial=-1)) + 1, unknown, np.int64)
    ids[found.column("place").to_numpy()] = found.column("id").to_numpy()
    bounds = pa.array(np.append(0, np.cumsum(pc.list_value_length(codes).to_numpy())), pa.int32())
    coded = pa.ListArray.from_arrays(bounds, pa.array(ids[codes.flatten().to_numpy()]))
    return pa.table([blocks.column("key"), blocks.column("block"), coded], names=["key", "block", "ids"])
