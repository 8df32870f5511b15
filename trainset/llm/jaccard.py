"""Documents linked by n-gram Jaccard similarity, joined on adaptive multi-match prefixes.

A document's set holds its distinct word shingles. Shingles have one global order: the common ones last, by how
often they were counted, the others by hash. A set of n shingles that must share c of them with any partner
has the prefix of its first n - c + l shingles, and two linked sets share at least min(l, l') shingles of their prefixes.
Each document takes the l of least estimated cost: every prefix shingle costs ``SHIP`` shipments of the set, the candidates
it brings are verified only if they come l times. So documents of rare shingles have the shortest prefix, and
documents made of common passages a longer one that asks for more matches.

Counts are taken window by window, ``WINDOW`` shingles each: those seen ``LOCAL`` times in a window are added up, and
common is what reaches ``COMMON`` and one in ``PARTS`` of all shingles, so there are at most ``PARTS`` common ones. They only
order and cost; a wrong count makes no difference to the links.

Short lists of a shingle give pairs, counted by pair; those with enough matches are compared by parity sketches (a
shingle flips one bit, so sketches never differ in more bits than sets in shingles). A list of over ``LIST`` documents
goes, with sketches, to tasks in pairs of blocks of bounded size, which return a forest of the pairs near by sketch,
never all pairs. What is near joins texts to groups that no link leaves. Then the sets of a group meet, again in pairs of
blocks of bounded size, and are compared shingle by shingle: a task follows one document after the other until all that are not yet
followed are in one component, asks each pair for its matches before it is verified, and returns a forest of links. So copies by the
thousand and passages that many documents share stay linear in rows, and a set is sent once a block, not once a pair.

Equal texts are one class from the start (by MD5) and each distinct text is compared once.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; its component is its
own id. A null id takes part and is never a component's name unless all its ids are null. Rows with one id are documents of
their own. Repeated rows give repeated rows. Shingles are held as 64-bit hashes. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from trainset.llm.common import materialize
from trainset.llm.hotkeys import join_hot
from trainset.llm.simhash import components
from trainset.llm.wordhash import LOWER, Hashes, joined, segments

SHINGLE = 3
PERCENT = 90
WINDOW, LOCAL = 1 << 21, 4
COMMON, PARTS = 32, 1 << 19
SHIP = 1.0  # of a set's size, against one candidate
LIST = 64
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1 << 21
SEEN = 1 << 16  # texts a task remembers to have had
_GAP = re.compile(rb"[\x20\x09-\x0d]")


# ---------------------------------------------------------------- sets


def shingle_set(text: bytes, hashes: Hashes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; of the whole text, if it has fewer words."""
    parts = [hashes.of(words) for segment in segments(text.translate(LOWER), _GAP) if (words := segment.split())]
    if not parts:
        return np.zeros(0, np.uint64)
    words = np.concatenate(parts)
    size = min(shingle, len(words))
    level = words[: len(words) - size + 1] ^ np.uint64(size)
    for k in range(1, size):
        level = joined(level, words[k : len(words) - size + 1 + k])
    return np.unique(level)


class Texts:
    """Which texts a task has had lately; it forgets all when it has had ``SEEN``."""

    def __init__(self) -> None:
        self.had: dict[bytes, int] = {}

    def keep(self, uid: bytes, n: int) -> None:
        if len(self.had) >= SEEN:
            self.had.clear()
        self.had[uid] = n


def _text_ids(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.unhex(F.md5("text")).alias("uid"), F.encode("text", "UTF-8").alias("text"))


def sizes_and_counts(texts: DataFrame, shingle: int) -> DataFrame:
    """A row (doc_id, uid, n) for each document; rows (token, f) of shingles that came often in a window."""
    schema = StructType([*texts.select("doc_id", "uid").schema.fields]).add("n", "integer").add("token", "long").add("f", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts, held, size = Hashes(), Texts(), [], 0
        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            uids, n = batch.column(1).to_pylist(), []
            for uid, value in zip(uids, batch.column(2)):
                if (known := texts.had.get(uid)) is None:
                    found = shingle_set(value.as_py(), hashes, shingle)
                    known = len(found)
                    texts.keep(uid, known)
                    held.append(found)
                    size += known
                n.append(known)
            nulls = pa.nulls(len(uids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), nulls, nulls], names=schema.names)
            if size >= WINDOW:
                yield _often(held, id_type, schema.names)
                held, size = [], 0
        if held:
            yield _often(held, id_type, schema.names)

    return texts.mapInArrow(read, schema)


def _often(held: list[np.ndarray], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    tokens, f = np.unique(np.concatenate(held), return_counts=True)
    tokens, f = tokens[f >= LOCAL], f[f >= LOCAL]
    size = len(tokens)
    columns = [pa.nulls(size, id_type), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int32()), pa.array(tokens.view(np.int64), pa.int64()), pa.array(f, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def common_shingles(read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``PARTS`` shingles, ascending, and their counts."""
    total = read.agg(F.sum("n")).first()[0] or 0
    counts = read.where("token is not null").groupBy("token").agg(F.sum("f").alias("f"))
    found = counts.where((F.col("f") >= COMMON) & (F.col("f") * PARTS >= total)).toArrow()
    tokens, f = found.column("token").to_numpy().view(np.uint64), found.column("f").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], f[order]


# ---------------------------------------------------------------- prefixes


def required(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any linked one."""
    return -(-percent * n // 100)


def ordered(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, with the counts of its shingles (0: not common)."""
    tokens, counts = common
    f = np.zeros(len(found), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
        f = np.where(tokens[at] == found, counts[at], 0)
    order = np.lexsort((found, f))
    return found[order], f[order]


def matches(f: np.ndarray, percent: int) -> int:
    """The number l of matches that a set, its counts in the global order, had best ask for."""
    n = len(f)
    least = required(n, percent)
    candidates = np.cumsum(np.maximum(f - 1, 0))[n - least :]
    asked = np.arange(1, least + 1)
    return int(np.argmin(SHIP * n * asked + candidates / asked)) + 1


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash, in a power of two of 64-bit words, at least a bit for each shingle."""
    bits = 64
    while bits < len(found):
        bits *= 2
    parity = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded: no more than the shingles that are in one set only."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())  # of signed numbers it counts the bits of the absolute value


def may_link(distance, n, m, percent: int):
    """Sets of n and m shingles that differ in ``distance`` at least: can the shared be ``percent`` of all?"""
    return 100 * (n + m - distance) >= percent * (n + m + distance)


def prefixes(texts: DataFrame, common, shingle: int, percent: int) -> DataFrame:
    """(uid, n, ell, rare, tokens, sketch): the prefix of each distinct text, its first ``rare`` shingles not common."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts = Hashes(), Texts()
        for batch in batches:
            out = []
            for uid, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if uid in texts.had:
                    continue
                found, f = ordered(shingle_set(value.as_py(), hashes, shingle), common.value)
                texts.keep(uid, len(found))
                if len(found):
                    ell = matches(f, percent)
                    size = len(found) - required(len(found), percent) + ell
                    out.append((uid, len(found), ell, int((f[:size] == 0).sum()), found[:size].view(np.int64), sketch(found)))
            kinds = {"uid": pa.binary(), "n": pa.int32(), "ell": pa.int32(), "rare": pa.int32(), "tokens": pa.list_(pa.int64()), "sketch": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds.items())})

    cuts = texts.select("uid", "text").mapInArrow(cut, "uid binary, n int, ell int, rare int, tokens array<long>, sketch array<long>")
    return cuts.groupBy("uid").agg(*(F.first(c).alias(c) for c in cuts.columns[1:]))


def lists(made: DataFrame) -> DataFrame:
    """(token, uid, n, ell, m): the documents with each prefix shingle that at least two have."""
    rows = made.select("uid", "n", "ell", "rare", F.posexplode("tokens").alias("at", "token"))
    rare = rows.where("at < rare").select("token", "uid", "n", "ell")
    alike = Window.partitionBy("token")
    rare = rare.withColumn("m", F.count("*").over(alike)).where("m > 1")
    common = rows.where("at >= rare").select("token", "uid", "n", "ell")
    counts = common.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    return rare.unionByName(common.join(F.broadcast(counts), "token"))  # a row for each common shingle: at most PARTS


# ---------------------------------------------------------------- short lists


def candidate_pairs(short: DataFrame, percent: int) -> DataFrame:
    """(a, b) with enough matches for one of them."""
    a, b = (short.select("token", *(F.col(c).alias(c + s) for c in ("uid", "n", "ell"))) for s in ("_a", "_b"))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    pairs = a.join(b, "token").where((F.col("uid_a") < F.col("uid_b")) & sizes)
    asked = F.least(F.first("ell_a"), F.first("ell_b"))
    counted = pairs.groupBy("uid_a", "uid_b").agg(F.count("*").alias("shared"), asked.alias("asked"))
    return counted.where("shared >= asked").select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b"))


def near_pairs(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule a link out."""
    for side in ("a", "b"):
        pairs = pairs.join(made.select(F.col("uid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), _arrays(batch.column(4)), _arrays(batch.column(5)))
            kept = [may_link(sketch_distance(x, y), n, m, percent) for n, m, x, y in rows]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(check, "a binary, b binary")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)) if len(column) else []
    return np.split(flat, ends[:-1]) if len(column) else []


def linked(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


# ---------------------------------------------------------------- groups of any size


def spanning(count: int, partners) -> list[tuple[int, int]]:
    """A forest with the components of a graph: ``partners(a, some)`` are a's neighbours among the mask ``some``.

    One member after the other is followed until all that are left are in one component.
    """
    label, todo = np.arange(count), np.ones(count, bool)
    links: list[tuple[int, int]] = []
    while True:
        left = np.flatnonzero(todo)
        outside = left[label[left] != np.bincount(label[left]).argmax()] if len(left) else left
        if not len(outside):
            return links
        a = int(outside[0])
        todo[a] = False
        for b in partners(a, label != label[a]).tolist():
            if label[b] != label[a]:
                links.append((a, b))
                label[label == label[b]] = label[a]


def near_forest(n: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs that sketches do not rule out."""
    words = np.array([len(x) for x in sketches])
    classes = {w: np.flatnonzero(words == w) for w in set(words.tolist())}
    whole = {w: np.array([sketches[i] for i in at]).view(np.uint64) for w, at in classes.items()}
    folded = {w // 2: (classes[w], m[:, : w // 2] ^ m[:, w // 2 :]) for w, m in whole.items() if w > 1}

    def partners(a: int, some: np.ndarray) -> np.ndarray:
        w, own = int(words[a]), sketches[a].view(np.uint64)
        found = [(classes[w], whole[w], own)]  # sets of sketches of other lengths differ too much in size
        if w in folded:
            found.append((*folded[w], own))
        if w // 2 in whole:
            found.append((classes[w // 2], whole[w // 2], own[: w // 2] ^ own[w // 2 :]))
        out = []
        for at, matrix, mine in found:
            distance = np.bitwise_count(matrix ^ mine).sum(axis=1, dtype=np.int64)
            out.append(at[may_link(distance, n[at], n[a], percent) & some[at]])
        return np.concatenate(out)

    return spanning(len(n), partners)


def forest(sets: list[np.ndarray], ell: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links with the same components as all links among ``sets``, each in the global order."""
    count = len(sets)
    n = np.array([len(s) for s in sets])
    prefix = n - np.array([required(int(x), percent) for x in n]) + ell
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(count), n)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    full, front = _Postings(ids, owner, np.ones(len(ids), bool)), _Postings(ids, owner, place < np.repeat(prefix, n))
    own = np.split(ids, np.cumsum(n)[:-1])

    def partners(a: int, some: np.ndarray) -> np.ndarray:
        matched = front.shared(own[a][: prefix[a]], count) >= np.minimum(ell, ell[a])
        some = some & matched & (np.minimum(n, n[a]) * 100 >= np.maximum(n, n[a]) * percent)
        return np.flatnonzero(some & linked(full.shared(own[a], count), n, n[a], percent)) if some.any() else np.zeros(0, int)

    return spanning(count, partners)


class _Postings:
    """The documents that hold each shingle."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, which: np.ndarray) -> None:
        order = np.argsort(ids[which], kind="stable")
        self.owner = owner[which][order]
        self.starts = np.searchsorted(ids[which][order], np.arange(int(ids.max()) + 2))

    def shared(self, ids: np.ndarray, count: int) -> np.ndarray:
        first, sizes = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.owner[at], minlength=count)


def block_pairs(rows: DataFrame, key: str, blocks) -> DataFrame:
    """Rows of each group ``key`` dealt into ``blocks`` blocks, for every pair of blocks (i, j); one block is a pair of its own."""
    dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other or blocks = 1")
    return dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *rows.columns).drop("m")


def _edges(uids: list[bytes], found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({c: pa.array([uids[x[k]] for x in found], pa.binary()) for k, c in enumerate(("a", "b"))})


def long_lists_near(long: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """A forest (a, b) of the pairs near by sketch in each long list."""

    def follow(group: pa.Table) -> pa.Table:
        sketches = _arrays(group.column("sketch").combine_chunks())
        return _edges(group.column("uid").to_pylist(), near_forest(group.column("n").to_numpy(), sketches, percent))

    held = block_pairs(long.select("token", "uid", "m"), "token", F.ceil(F.col("m") / BLOCK_DOCS)).join(made.select("uid", "n", "sketch"), "uid")
    return held.groupBy("token", "i", "j").applyInArrow(follow, "a binary, b binary")


def group_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A forest (a, b) of the links in each group (uid, root) of texts."""

    def follow(group: pa.Table) -> pa.Table:
        found = [x.view(np.uint64) for x in _arrays(group.column("shingles").combine_chunks())]
        return _edges(group.column("uid").to_pylist(), forest(found, group.column("ell").to_numpy(), percent))

    sized = groups.join(sets.select("uid", "n"), "uid").groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.col("size") / BLOCK_SHINGLES))
    rows = join_hot(groups, sized.select("root", blocks.alias("m")), ["root"])
    held = block_pairs(rows, "root", F.col("m")).join(sets.select("uid", "ell", "shingles"), "uid")
    return held.groupBy("root", "i", "j").applyInArrow(follow, "a binary, b binary")


# ---------------------------------------------------------------- links and components


def sets_of(texts: DataFrame, wanted: DataFrame, common, made: DataFrame, shingle: int) -> DataFrame:
    """(uid, n, ell, shingles): the sets of wanted texts, in the global order."""
    once = texts.groupBy("uid").agg(F.first("text").alias("text")).join(wanted, "uid", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found = [ordered(shingle_set(v.as_py(), hashes, shingle), common.value)[0].view(np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["uid", "shingles"])

    return once.select("uid", "text").mapInArrow(read, "uid binary, shingles array<long>").join(made.select("uid", "n", "ell"), "uid")


def find_links(texts: DataFrame, read: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between texts that give the components of all links."""
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(read))  # at most PARTS of 16 bytes
    made = materialize(prefixes(texts, common, shingle, percent), "jaccard-prefixes")
    held = materialize(lists(made), "jaccard-lists")
    near = near_pairs(candidate_pairs(held.where(F.col("m") <= LIST), percent), made, percent)
    near = materialize(near.unionByName(long_lists_near(held.where(F.col("m") > LIST), made, percent)), "jaccard-near")
    groups = components(near).select(F.col("node").alias("uid"), "root")
    groups = materialize(groups.unionByName(groups.select(F.col("root").alias("uid"), "root").distinct()), "jaccard-groups")
    sets = materialize(sets_of(texts, groups.select("uid"), common, made, shingle), "jaccard-sets")
    return group_links(groups, sets, percent)


def jaccard_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id reachable by links)."""
    texts = _text_ids(docs, doc_id, text)
    read = materialize(sizes_and_counts(texts, shingle), "jaccard-read")
    members = read.where("uid is not null").select("doc_id", "uid", F.col("n").cast("long").alias("n_shingles"))
    links = materialize(find_links(texts, read, shingle=shingle, percent=percent), "jaccard-links")
    roots = components(links).select(F.col("node").alias("uid"), "root")
    firsts = members.where("n_shingles > 0").groupBy("uid").agg(F.min("doc_id").alias("first"))
    rooted = materialize(firsts.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "jaccard-roots")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_text = materialize(join_hot(rooted.select("uid", "root"), named, ["root"]).select("uid", "component_id"), "jaccard-classes")
    joined_rows = join_hot(members.where("n_shingles > 0"), by_text, ["uid"]).select("doc_id", "n_shingles", "component_id")
    alone = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined_rows.unionByName(alone)
