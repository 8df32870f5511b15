"""Quality classifier: ridge regression on random Fourier features of document statistics.

Statistics of the whole text (sizes, shares of kinds of characters, repetition of words, pairs and
lines) are standardised over the training rows. Cosines of seeded random projections of them
approximate a Gaussian kernel; the normal equations of the ridge regression on the labels are added up
by partition and solved once. Raw scores become probabilities by isotonic regression over a fixed grid
of score bins. Every labelled training row takes part in each step.

Defined results: a null text counts as empty and is scored like any text. A null doc_id is in no fold
that is held out and has no label. Several labels of a document count by their mean; null labels do
not count. Without any training row every score is 0.5. Repeated rows are scored one by one. Columns
other than those named are not read by ``score_quality``; ``keep_good`` keeps all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trainset.llm.common import crc_bucket, materialize, packed, utf8
from trainset.llm.sums import matrix, partition_sums

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
COSINES = 256
BANDWIDTH = 4.0  # of the Gaussian kernel, in standard deviations
RIDGE = 1.0
GRID = 400  # score bins between 0 and 1
SEED = 7

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([b in b".,;:?'\"-()" for b in range(256)])
_SIGN = np.array([b in b"|#$%&*@^~<>{}[]\\/_=+`" for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
WIDTH = 20


def statistics(text: bytes) -> list[float]:
    """``WIDTH`` statistics of a text; an empty text has zeros."""
    if not text:
        return [0.0] * WIDTH
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    words = text.split()
    count = len(words) or 1
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    letters = int(seen[_LETTER].sum()) or 1
    shares = seen[seen > 0] / size
    return [
        np.log1p(size),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        np.log1p(float(lengths.max())),
        float(seen[_UPPER].sum()) / letters,
        float(seen[_DIGIT].sum()) / size,
        float(seen[_MARK].sum()) / count,
        float(seen[_SIGN].sum()) / count,
        float(seen[33]) / count,
        float(seen[_SPACE].sum()) / size,
        float(seen[128:].sum()) / size,
        distinct / count,
        (pairs + 1) / count,
        repeats / count,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(count / (1 + int(seen[46] + seen[63]))),
        float(-(shares * np.log2(shares)).sum()),
        float(seen[:9].sum() + seen[14:32].sum()) / size,
    ]


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def cosines(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions = rng.normal(size=(WIDTH, COSINES)) / BANDWIDTH
        phases = rng.uniform(0, 2 * np.pi, COSINES)
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ directions + phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def isotonic(means: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The closest rising sequence, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for mean, size in zip(means, sizes):
        blocks.append([mean, size, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, s, n = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[2] = (b[0] * b[1] + m * s) / (b[1] + s), b[1] + s, b[2] + n
    return np.concatenate([np.full(int(n), m) for m, _, n in blocks])


def _stats_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(v) for v in utf8(batch.column(1))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["doc_id", "stats"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(measure, f"doc_id {kind}, stats array<double>")


def labels_of(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("label"))


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """A model from (doc_id, stats) and (doc_id, label); None without a training row."""
    rows = stats.where(crc_bucket("doc_id", FOLDS) != HELD_OUT).join(labels, "doc_id").select("stats", "label")
    rows = materialize(rows, "quality-training")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), WIDTH)
        return np.vstack([x.sum(axis=0), (x * x).sum(axis=0), np.full(WIDTH, float(len(x)))])

    total, squares, count = partition_sums(rows, moments, (3, WIDTH))
    n = count[0]
    if not n:
        return None
    centre = total / n
    scale = np.sqrt(np.maximum(squares / n - centre * centre, 1e-12))
    model = Model(centre, np.where(scale < 1e-5, 1.0, scale), np.zeros(COSINES + 1), (np.zeros(1), np.full(1, 0.5)))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.cosines(matrix(batch.column(0), WIDTH))
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    sums = partition_sums(rows, equations, (COSINES + 1, COSINES + 2))
    ridge = RIDGE * np.eye(COSINES + 1)
    ridge[-1, -1] = 0  # the constant is free
    model.weights = np.linalg.solve(sums[:, :-1] + ridge + 1e-9 * np.eye(COSINES + 1), sums[:, -1])

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip((model.raw(matrix(batch.column(0), WIDTH)) * GRID).astype(int) + GRID, 0, 3 * GRID - 1)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return np.vstack([np.bincount(at, minlength=3 * GRID), np.bincount(at, y, minlength=3 * GRID)])

    size, good = partition_sums(rows, bins, (2, 3 * GRID))
    filled = size > 0
    centres = ((np.arange(3 * GRID) - GRID + 0.5) / GRID)[filled]
    model.knots = (centres, isotonic(good[filled] / size[filled], size[filled]))
    return model


def _scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), 0.5) if model is None else model.score(x)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = materialize(_stats_of(docs, doc_id, text), "quality-stats")
    model = fit(stats, labels_of(labels, doc_id, label))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(model, matrix(batch.column(1), WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = stats.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (crc_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", _verdict(F.col("score")).alias("predicted")
    )


def _verdict(score: Column) -> Column:
    return F.when(score >= THRESHOLD, 1).otherwise(0).cast("int")


def keep_good(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """All columns of the documents that score ``THRESHOLD`` or more.

    Documents are measured twice: narrow rows for the fit, then on their way through.
    """
    known = labels_of(labels, doc_id, label)
    model = fit(materialize(_stats_of(docs, doc_id, text), "quality-stats"), known)
    rows = packed(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(v) for v in utf8(batch.column(0).field(text))], float).reshape(-1, WIDTH)
            yield batch.filter(pa.array(_scores(model, x) >= THRESHOLD))

    return rows.mapInArrow(keep, rows.schema).select("row.*")
