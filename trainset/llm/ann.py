"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample of the distinct vectors; every vector is then filed in the leaf
it reaches by following the nearest centre. A query keeps the nodes it has seen in a priority queue and
takes the best one until it has visited a number of leaves. A leaf ranks by the similarity to its
centre, an inner node by what its centre and the spread of its vectors let hope for. The number of visits
is found by calibration: a bounded sample of queries is compared with all vectors, and the visits
are widened until so many of their true neighbours lie in visited leaves.

Equal vectors are filed once, with as many of their least ids as a result can need, so a vector that
a third of the rows share costs no more than another. Leaves and the queries that visit them meet in
blocks of bounded size; each block returns its best per query.

Nearness is the cosine in double precision of the vectors as given. Defined results: a null id, and
vectors that are null, empty, zero, hold null or non-finite components, or have another length than
most, take no part. Rows equal in id and vector count once; rows with the query's id are its own and no
candidates. Rows of one id with different vectors are queries of their own, whose results stand side by side under that id,
and candidates of their own. Ties go to the lesser id. Fewer candidates than ``k``: all. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trainset.llm.common import materialize

NEIGHBOURS = 5
EVERY = 50  # ids divisible by it are queries
SAMPLE = 20_000  # vectors the tree is fitted on,
SAMPLE_VALUES = 4_000_000  # and numbers in them: fewer vectors, if they are long
BRANCHES = 16  # of a node, and no more than it takes to reach the size of a leaf
LEAF_ROWS = 250  # vectors in a leaf, about; fewer in small tables, for FEW_LEAVES leaves; no fewer than LEAF_SAMPLE of the sample
FEW_LEAVES = 64
LEAF_SAMPLE = 8
CALIBRATION = 200  # queries compared with all vectors
RECALL = 0.95  # of the neighbours of these
INDEX_BLOCK, QUERY_BLOCK = 4096, 2048
SEED = 5


def _scaled(x: np.ndarray) -> np.ndarray:
    """The rows times powers of two, which changes no digit, so that no square of their components leaves the doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


@dataclass
class Tree:
    centres: np.ndarray  # one row a node; node 0 is the root
    spread: np.ndarray  # mean angle between an inner node's vectors and its centre; 0 for leaves
    children: list[list[int]]
    leaf: list[int]  # number of the leaf, or -1

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out = np.empty(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            below = np.array(self.children[node])
            nearest = (x[rows] @ self.centres[below].T).argmax(axis=1)
            for i, child in enumerate(below):
                if (mine := rows[nearest == i]).size:
                    stack.append((int(child), mine))
        return out

    def visits(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves in best-bin-first order."""
        near = np.cos(np.maximum(np.arccos(np.clip(self.centres @ query, -1, 1)) - self.spread, 0))
        queue, out = [(-near[0], 0)], []
        while queue and len(out) < leaves:
            node = heapq.heappop(queue)[1]
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-near[child], child))
        return out


def grow(sample: np.ndarray, least: int, branches: int = BRANCHES) -> Tree:
    """Splits a sample by spherical k-means until a node has at most ``least`` vectors or cannot be split."""
    rng = np.random.default_rng(SEED)
    unit = _unit(sample)
    centres, spread, children, leaf = [_centre(unit)], [0.0], [[]], [-1]
    leaves, stack = 0, [(0, np.arange(len(unit)))]
    while stack:
        node, rows = stack.pop()
        wanted = min(branches, max(2, round(len(rows) / least)))
        groups = _split(unit[rows], wanted, rng) if len(rows) > least else []
        if len(groups) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        spread[node] = float(np.arccos(np.clip(unit[rows] @ centres[node], -1, 1)).mean())
        for group in groups:
            children[node].append(len(centres))
            stack.append((len(centres), rows[group]))
            centres.append(_centre(unit[rows[group]]))
            spread.append(0.0)
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centres), np.array(spread), children, leaf)


def _centre(x: np.ndarray) -> np.ndarray:
    mean = x.mean(axis=0)
    return mean / max(float(np.linalg.norm(mean)), 1e-12)


def _split(x: np.ndarray, branches: int, rng: np.random.Generator) -> list[np.ndarray]:
    centres = x[rng.choice(len(x), min(branches, len(x)), replace=False)]
    nearest = np.zeros(len(x), int)
    for _ in range(12):
        nearest = (x @ centres.T).argmax(axis=1)
        kept = [x[nearest == i].mean(axis=0) for i in range(len(centres)) if (nearest == i).any()]
        centres = np.array(kept) / np.maximum(np.linalg.norm(kept, axis=1, keepdims=True), 1e-12)
    nearest = (x @ centres.T).argmax(axis=1)
    return [g for i in range(len(centres)) if (g := np.flatnonzero(nearest == i)).size]


# ---------------------------------------------------------------- rows that take part


def usable(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Distinct (vec_id, v, h) of the rows that take part; h is a hash of the vector."""
    kind = "float" if embeddings.schema[vector].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))  # one zero
    return rows.withColumn("h", F.xxhash64("v")).distinct()


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(h, v, ids): each vector once with its least ids."""
    least = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    return rows.withColumn("n", least).where(F.col("n") <= ids).groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


# ---------------------------------------------------------------- blocks


def _best(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[int, int, float]]]:
    """For each query its ``k`` best (position, id, cosine) among ``vectors``, ties to the lesser id."""
    queries, vectors = _scaled(queries), _scaled(vectors)
    sizes = np.linalg.norm(vectors, axis=1)
    out = []
    near = (queries @ vectors.T) / sizes
    for i in range(len(queries)):
        row = near[i]
        if len(row) > k + 1:
            edge = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
            some = np.flatnonzero(row >= edge - 1e-12 * abs(edge))
        else:
            some = np.arange(len(row))
        exact = (vectors[some] * queries[i]).sum(axis=1) / (sizes[some] * np.sqrt((queries[i] * queries[i]).sum()))
        pairs = [(-s, x, j) for s, j in zip(exact.tolist(), some.tolist()) for x in ids[j] if x != own[i]]
        out.append([(j, x, -s) for s, x, j in heapq.nsmallest(k, pairs)])
    return out


def _exact(index: DataFrame, queries: list, k: int) -> list[list[int]]:
    """The leaves of the true neighbours of a few queries, each compared with every vector."""
    q = np.array([r["v"] for r in queries], float)
    own = np.array([r["vec_id"] for r in queries])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column(2).to_pylist()
            best = _best(q, own, _matrix(batch.column(0)), batch.column(1).to_pylist(), k)
            rows = [(i, leaf[j], x, s) for i, found in enumerate(best) for j, x, s in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64()))],
                names=["q", "leaf", "vec_id", "score"],
            )

    found = index.select("v", "ids", "leaf").mapInArrow(compare, "q int, leaf int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    out: list[list[int]] = [[] for _ in queries]
    for row in found.withColumn("rank", rank).where(F.col("rank") <= k).collect():  # k for each sampled query
        out[row["q"]].append(row["leaf"])
    return out


def calibrated_visits(tree: Tree, queries: list, leaves_of: list[list[int]], recall: float) -> int:
    """The fewest visits, widened by a sixteenth each time, that reach ``recall`` on sampled queries."""
    orders = [{leaf: i for i, leaf in enumerate(tree.visits(_unit(np.array([r["v"]], float))[0], tree.leaves))} for r in queries]
    places = np.array([order[leaf] for order, leaves in zip(orders, leaves_of) for leaf in leaves])
    visits = 1
    while visits < tree.leaves and len(places) and (places < visits).mean() < recall:
        visits = min(tree.leaves, visits + max(1, visits // 16))
    return visits


def nearest(
    embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS,
    sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, calibration: int = CALIBRATION, recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each id divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = materialize(usable(embeddings, vec_id, vector), "ann-rows")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == length["n"])
    vectors = materialize(distinct_vectors(rows, k + 1), "ann-vectors")
    total = vectors.count()
    order = F.xxhash64("h", F.lit(SEED))
    sampled = vectors.select("v").orderBy(order, "v").limit(max(1, min(sample, SAMPLE_VALUES // length["n"]))).collect()  # at most SAMPLE_VALUES numbers
    tree = grow(np.array([r["v"] for r in sampled], float), max(LEAF_SAMPLE, round(len(sampled) * min(leaf_rows / total, 1 / FEW_LEAVES))))
    shared = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.file(_unit(_matrix(batch.column(1)))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["h", "v", "ids", "leaf"])

    kind = vectors.schema["v"].dataType.simpleString()
    filed = vectors.select("h", "v", "ids").mapInArrow(file, f"h long, v {kind}, ids array<long>, leaf int")
    index = materialize(filed, "ann-index")
    queries = rows.where(F.col("vec_id") % every == 0)
    few = queries.orderBy(order, "vec_id").limit(calibration).collect()
    visits = calibrated_visits(tree, few, _exact(index, few, k), recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = [shared.value.visits(q, visits) for q in _unit(_matrix(batch.column(1)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=["vec_id", "v", "h", "leaves"])

    visiting = queries.select("vec_id", "v", "h").mapInArrow(visit, f"vec_id long, v {kind}, h long, leaves array<int>")
    visiting = materialize(visiting.select("vec_id", "v", "h", F.explode("leaves").alias("leaf")), "ann-visits")
    blocks = _block_counts(index, visiting)
    left = visiting.join(F.broadcast(blocks), "leaf").select(
        "vec_id", "v", "h", "leaf", F.pmod(F.xxhash64("vec_id", "h"), "q_blocks").alias("qb"), F.explode(_numbers("i_blocks")).alias("ib")
    )
    right = index.join(F.broadcast(blocks), "leaf").select(
        "v", "ids", "leaf", F.explode(_numbers("q_blocks")).alias("qb"), F.pmod(F.xxhash64("h"), "i_blocks").alias("ib")
    )
    keys = ("leaf", "qb", "ib")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, h long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        own, h = left.column("vec_id").to_numpy(), left.column("h").to_numpy()
        rows: list[tuple[int, int, int, float]] = []
        if left.num_rows and right.num_rows:
            best = _best(_matrix(left.column("v").chunk(0)), own, _matrix(right.column("v").chunk(0)), right.column("ids").to_pylist(), k)
            rows = [(int(own[i]), int(h[i]), x, s) for i, found in enumerate(best) for _, x, s in found]
        kinds = {"query_id": pa.int64(), "h": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({name: pa.array([r[c] for r in rows], kind) for c, (name, kind) in enumerate(kinds.items())})

    return search


def _numbers(count: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def _block_counts(index: DataFrame, visiting: DataFrame) -> DataFrame:
    """Into how many blocks the vectors and the visits of each leaf are dealt: a row for each leaf, no more than sampled vectors."""
    held = index.groupBy("leaf").agg(F.ceil(F.count("*") / INDEX_BLOCK).alias("i_blocks"))
    seen = visiting.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("q_blocks"))
    return held.join(seen, "leaf")
