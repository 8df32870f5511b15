"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each of 64 positions: 1 if set in over half of the XXH64 values (seed 42)
of the text's word shingles. Two fingerprints are linked if they differ in at most ``radius`` bits.

Covering masks: each bit position gets a non-zero vector of radius + 1 bits; for each of the
2 ** (radius + 1) - 1 non-zero vectors v, mask v keeps the positions whose vector has an odd scalar
product with v. The vectors of at most ``radius`` differing positions leave some v orthogonal to all of
them, so every linked pair agrees in at least one mask: no pair is missed, whatever the data.

Buckets are equal (mask, masked fingerprint) over distinct fingerprints. A bucket of two is compared at
once; a larger one is clustered in a task, which returns a forest of links between real neighbours, never all
pairs. A bucket of over ``BUCKET`` fingerprints is dealt anew by all masks over the bits that its mask
left out; a pair in it differs in those bits only, so some finer bucket holds it. Every finer mask keeps
more bits than its bucket's own, and one that leaves ``FREE`` bits or fewer is dealt no further: it holds
at most 2 ** ``FREE`` distinct fingerprints, which one task clusters. So the levels end and buckets stay
bounded even in a table of near copies of one text; with radius 4 the second level is the last.

Components grow by linking every node and its neighbours to the least of them, and the linked to
those, until nothing changes; each round is a written table.

Defined results: a null text, or one without words, has fingerprint zero, linked like any other. A
null document id takes part and is never a component's name unless all of its ids are null. Repeated
rows give repeated rows. Extra columns are kept by ``keep_one_per_group`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trainset.llm.common import materialize, utf8

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 2048
FREE = 16
_BITS = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        n = len(words) - shingle + 1
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the values; byte lanes count up to 255 values at a time."""
    counts = np.zeros((8, 8), np.int64)  # [bit in byte, byte]
    for first in range(0, len(hashes), 255):
        block = hashes[first : first + 255]
        for bit in range(8):
            lanes = ((block >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64)
            counts[bit] += np.frombuffer(np.uint64(lanes).tobytes(), np.uint8)
    bits = counts.T.reshape(_BITS) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """``docs`` with the fingerprint of ``text``, a column or a field of struct ``row``, as a signed 64-bit column."""
    from pyspark.sql.types import StructType

    columns = docs.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(row or text)
        for batch in batches:
            texts = batch.column(at).field(text) if row else batch.column(at)
            values = np.array([fingerprint(v, shingle) for v in utf8(texts)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=[*columns, name])

    return docs.mapInArrow(add, StructType([*docs.schema.fields]).add(name, "long"))


# ---------------------------------------------------------------- covering masks


def _signed(value: int) -> int:
    return value - (1 << _BITS) if value >> (_BITS - 1) else value


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over some bit positions; any ``radius`` of these are all left out by one mask at least.

    The unit vectors are given first, so with more than ``radius`` positions no mask is empty.
    """
    vectors = (1 << (radius + 1)) - 1
    order = sorted(range(1, vectors + 1), key=lambda v: (v.bit_count() > 1, v))
    given = {p: order[i % vectors] for i, p in enumerate(positions)}
    return [sum(1 << p for p, m in given.items() if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _free(mask: int) -> list[int]:
    return [p for p in range(_BITS) if not mask >> p & 1]


# ---------------------------------------------------------------- links


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a forest with the same components as all links of distance ``radius`` or less.

    Hubs gather what is near them; only hubs within three radii can have linked members, and their
    members are compared hub by hub unless they are connected already.
    """
    rest = np.arange(len(values))
    hubs: list[np.ndarray] = []
    links: list[tuple[int, int]] = []
    while len(rest):
        near = np.bitwise_count(values[rest] ^ values[rest[0]]) <= radius
        members = rest[near]
        links += [(int(members[0]), int(m)) for m in members[1:]]
        hubs.append(members)
        rest = rest[~near]
    root = list(range(len(hubs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    centres = values[[h[0] for h in hubs]]
    for i in range(1, len(hubs)):
        for j in np.flatnonzero(np.bitwise_count(centres[:i] ^ centres[i]) <= 3 * radius):
            if find(i) == find(int(j)):
                continue
            a, b = hubs[i], hubs[j]
            for m in a if len(a) <= len(b) else b:
                other = b if len(a) <= len(b) else a
                hit = np.flatnonzero(np.bitwise_count(values[other] ^ values[m]) <= radius)
                if len(hit):
                    links.append((int(m), int(other[hit[0]])))
                    root[find(i)] = find(int(j))
                    break
    return links


def _link(buckets: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets of bounded size: (table, key) groups of distinct fingerprints ``fp``."""

    def cluster(group: pa.Table) -> pa.Table:
        values = np.sort(np.array(group.column("fp"), np.int64))
        found = spanning_links(values.view(np.uint64), radius)
        a, b = (values[[x[k] for x in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return buckets.groupBy("table", "key").applyInArrow(cluster, "a long, b long")


def find_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that give the components of all links."""
    masks = covering_masks(list(range(_BITS)), radius)
    tables = F.array(*(F.struct(F.lit(i).cast("long").alias("table"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)))
    rows = distinct.select("fp", F.explode(tables).alias("t"))
    rows = rows.select("fp", F.col("t.table").alias("table"), F.col("t.mask").alias("mask"))
    rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    out: list[DataFrame] = []
    level = 1
    while True:
        sizes = rows.groupBy("table", "mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        sizes = materialize(sizes.where("n > 1"), "simhash-buckets")
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        out.append(sizes.where((F.col("n") == 2) & (apart <= radius)).select("a", "b"))
        last = F.lit(_BITS) - F.bit_count("mask") <= max(FREE, radius + 1)
        some = sizes.where((F.col("n") > 2) & ((F.col("n") <= bucket) | last)).select("table", "key")
        out.append(_link(rows.join(some, ["table", "key"]).select("table", "key", "fp"), radius))
        large = sizes.where((F.col("n") > bucket) & ~last).select("table", "mask", "key")
        split = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most 31 at the first level
        if not split:
            break
        rows = materialize(_dealt_anew(rows.join(large, ["table", "mask", "key"]), split, radius), f"simhash-level{level}")
        level += 1
    links = out[0]
    for more in out[1:]:
        links = links.unionAll(more)
    return links


def _dealt_anew(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """The rows of large buckets under finer masks: the bucket's own and a covering mask of its free bits."""
    finer = []
    for mask in masks:
        own = mask % (1 << _BITS)
        finer.append((mask, [_signed(own | m) for m in covering_masks(_free(own), radius)]))
    choice = F.broadcast(rows.sparkSession.createDataFrame(finer, "mask long, finer array<long>"))  # a row per mask
    fine = rows.join(choice, "mask").select("fp", F.posexplode("finer").alias("i", "mask"), F.xxhash64("table", "key").alias("table"))
    return fine.select("fp", F.xxhash64("table", "i").alias("table"), "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node of its component.

    Rounds of large-star and small-star: nodes point to the least neighbour, until the star is stable.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "simhash-edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = materialize(small.where("a <> b").distinct(), "simhash-edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)


def _roots(prints: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(fp, root fingerprint) for the fingerprints that are linked to a lesser one."""
    distinct = materialize(prints.select("fp").distinct(), "simhash-distinct")
    links = materialize(find_links(distinct, radius, bucket), "simhash-links")
    return components(links).select(F.col("node").alias("fp"), "root")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle)
    prints = materialize(prints.select("doc_id", "fp"), "simhash-prints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = firsts.join(_roots(prints, radius, bucket), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET,
) -> DataFrame:
    """All columns of one document of each component: the one with the least id (any one, if several have it).

    The rows are written once with a number each, so that the choice means the same rows in each pass.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    numbered = docs.select(row, F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("uid"))
    written = materialize(fingerprints(numbered, text, "fp", shingle, row="row"), "simhash-rows")
    narrow = written.select("doc_id", "uid", "fp")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best")
    firsts = narrow.groupBy("fp").agg(best)
    rooted = firsts.join(_roots(narrow, radius, bucket), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.uid").alias("uid"))
    return written.select("row", "uid").join(kept, "uid").select("row.*")
