"""Toxicity by weak supervision.

1. Lexicons are mined from a bounded sample of labelled training rows: words and word beginnings that
   are far more frequent in the toxic ones. They are dealt to many lexicon voters; pattern voters look
   for known insults, disguised spelling, several different hits and dense hits.
2. A generative label model reads, from how often each voter and each pair of voters fires over all
   training documents, how accurate each voter is and which pairs agree beyond what the hidden class
   explains; such voters share their weight. No label is used here but the share of toxic ones.
3. A logistic regression on the lexicon hits is trained on the posterior labels of all those documents
   (equal rows once, with their count), by Newton steps whose sums are added up by partition. A
   last line through the training labels sets its scale.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased.

Defined results: null and empty texts have no hits and the score of such texts. A null doc_id is not
held out and has no label. Without toxic and clean training labels the score is that of the known
insults alone. Repeated rows are scored one by one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trainset.llm.common import crc_bucket, materialize, utf8
from trainset.llm.decontaminate import words_of
from trainset.llm.quality import labels_of
from trainset.llm.sums import partition_sums

FOLDS, HELD_OUT = 5, 0
MAX_LABELLED = 20_000  # labelled rows of each class from which lexicons are mined
LEXICON = 240  # mined words and beginnings
LEXICON_VOTERS = 16
LEAST_DOCUMENTS = 4  # toxic documents that must hold a mined entry,
LEAST_SHARE = 0.01  # and the share of them
BEGINNINGS = (4, 5, 6)  # bytes
AGREES = 0.25  # residual correlation from which two voters count as correlated
NEWTON_STEPS = 8
RIDGE = 1.0
ROWS_A_TASK = 20_000

#: Plain English insults, as a lexicon that needs no labels.
INSULTS = (b"idiot", b"moron", b"stupid", b"loser", b"scum", b"trash", b"pathetic", b"worthless", b"disgusting", b"clown", b"dumb", b"imbecile")
PATTERNS = ("insult", "disguised", "two_hits", "four_hits", "dense")
VOTERS = LEXICON_VOTERS + len(PATTERNS)
_PLAIN = bytes.maketrans(b"013457@$", b"oieastas")


def entries_of(words: set[bytes]) -> set[bytes]:
    """Whole words, marked by a space, and beginnings of longer words."""
    out = {b" " + w for w in words}
    for n in BEGINNINGS:
        out |= {w[:n] for w in words if len(w) > n}
    return out


@dataclass
class Lexicon:
    entries: dict[bytes, int] = field(default_factory=dict)  # entry -> number

    def __post_init__(self) -> None:
        self.whole = {e[1:]: i for e, i in self.entries.items() if e[:1] == b" "}
        self.starts = [(n, {e: i for e, i in self.entries.items() if e[:1] != b" " and len(e) == n}) for n in BEGINNINGS]

    @property
    def width(self) -> int:
        return LEXICON + len(PATTERNS)

    def hits(self, text: bytes) -> tuple[list[int], int]:
        """Numbers of the entries and patterns found, and the votes as bits."""
        listed = words_of(text)
        words = set(listed)
        found: set[int] = set()
        hit_words: set[bytes] = set()
        for w in words & self.whole.keys():
            found.add(self.whole[w])
            hit_words.add(w)
        for n, starts in self.starts:
            for beginning in {w[:n] for w in words} & starts.keys():
                longer = {w for w in words if len(w) > n and w.startswith(beginning)}
                if longer:
                    found.add(starts[beginning])
                    hit_words |= longer
        insults = words.intersection(INSULTS)
        hit_words |= insults
        odd = {w.translate(_PLAIN) for w in text.translate(_LOWER).split() if _DISGUISE.intersection(w)}
        signs = {
            "insult": bool(insults),
            "disguised": any(o.strip(b".,!?;:") in self.whole or o.strip(b".,!?;:") in INSULTS for o in odd),
            "two_hits": len(hit_words) >= 2,
            "four_hits": len(hit_words) >= 4,
            "dense": len(hit_words) * 100 >= len(words) > 0,
        }
        votes = 0
        for i in found:
            votes |= 1 << (i % LEXICON_VOTERS)
        for k, name in enumerate(PATTERNS):
            if signs[name]:
                votes |= 1 << (LEXICON_VOTERS + k)
                found.add(LEXICON + k)
        return sorted(found), votes


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DISGUISE = set(b"01345789@$")


def mine(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The entries that best mark toxic documents, from (doc_id, text) and (doc_id, label)."""
    order = F.md5(F.col("doc_id").cast("string"))
    known = labels.where((crc_bucket("doc_id", FOLDS) != HELD_OUT)).select("doc_id", (F.col("label") > 0.5).alias("toxic"))
    some = known.where("toxic").orderBy(order).limit(MAX_LABELLED).unionAll(known.where("NOT toxic").orderBy(order).limit(MAX_LABELLED))
    texts = docs.join(F.broadcast(some), "doc_id").select("text", "toxic")  # at most 2 * MAX_LABELLED ids
    texts = texts.dropDuplicates()  # copies of one document say no more than it does

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                seen[toxic].update(entries_of(set(words_of(text))))
                seen[toxic][b""] += 1  # documents
        entries = list(seen[0].keys() | seen[1].keys())
        numbers = [pa.array([s[e] for e in entries], pa.int64()) for s in seen]
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.binary()), *numbers], names=["entry", "clean", "toxic"])

    counted = texts.mapInArrow(count, "entry binary, clean long, toxic long")
    totals = counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = materialize(totals.where((F.col("toxic") >= LEAST_DOCUMENTS) | (F.length("entry") == 0)), "toxicity-entries")
    size = totals.where(F.length("entry") == 0).first()
    if size is None or not size["clean"] or not size["toxic"]:
        return Lexicon()
    odds = F.ln((F.col("toxic") + 0.5) / F.lit(size["toxic"] + 1.0)) - F.ln((F.col("clean") + 0.5) / F.lit(size["clean"] + 1.0))
    often = F.col("toxic") >= F.lit(max(LEAST_DOCUMENTS, LEAST_SHARE * size["toxic"]))
    marks = totals.where((F.length("entry") > 0) & often).withColumn("odds", odds).where("odds > 2.5")
    best = marks.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "entry").limit(LEXICON).collect()
    return Lexicon({bytes(r["entry"]): i for i, r in enumerate(best)})


@dataclass
class LabelModel:
    prior: float
    fires: np.ndarray  # chance that a voter fires on clean (row 0) and toxic (row 1) documents
    share: np.ndarray  # weight left to each voter beside those correlated with it
    correlated: list[tuple[int, int]]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of toxic, from votes (documents x voters)."""
        yes, no = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        logit = np.log(self.prior / (1 - self.prior)) + (votes * yes + (1 - votes) * no) @ self.share
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(pairs: np.ndarray, documents: float, prior: float) -> LabelModel:
    """Accuracies and correlations from how often voters fire together (diagonal: alone).

    If voters were independent given the class, their covariances would be a rank-one matrix of how
    much more each fires on toxic documents. That matrix is fitted to the pairs not yet found to be
    correlated; pairs far above it are set apart, and it is fitted again. The start is the median of
    what each two other voters say of one, which a few correlated pairs do not move.
    """
    n = len(pairs)
    rate = np.diag(pairs) / max(documents, 1)
    deviation = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    agree = (pairs / max(documents, 1) - np.outer(rate, rate)) / np.outer(deviation, deviation)
    alive = rate > 0
    pairs_of = np.outer(alive, alive) & ~np.eye(n, dtype=bool)
    skill = np.array([_by_thirds(agree, pairs_of, j) for j in range(n)])
    residual = agree - np.outer(skill, skill)
    use = pairs_of & (residual < AGREES)
    for _ in range(4):
        for _ in range(50):
            for j in np.flatnonzero(alive):
                others = use[j]
                weight = (skill[others] ** 2).sum()
                skill[j] = np.clip((agree[j, others] * skill[others]).sum() / weight, 0.02, 0.98) if weight > 1e-9 else skill[j]
        residual = agree - np.outer(skill, skill)
        use = pairs_of & (residual < AGREES)
    apart = np.sqrt(prior * (1 - prior))
    toxic = rate + skill * deviation * (1 - prior) / apart
    clean = rate - skill * deviation * prior / apart
    fires = np.clip(np.vstack([clean, toxic]), 1e-4, 1 - 1e-4)
    fires[1] = np.maximum(fires[1], fires[0])
    tied = np.where((residual >= AGREES) & pairs_of, residual, 0.0)
    share = np.where(alive, 1 / (1 + np.abs(tied).sum(axis=1)), 0.0)
    return LabelModel(prior, fires, share, [(int(i), int(j)) for i, j in np.argwhere(np.triu(tied) > 0)])


def _by_thirds(agree: np.ndarray, pairs_of: np.ndarray, j: int) -> float:
    others = np.flatnonzero(pairs_of[j])
    a, b = np.triu_indices(len(others), 1)
    i, k = others[a], others[b]
    sound = agree[i, k] > 1e-3
    if not sound.any():
        return 0.5 if len(others) else 0.0
    squares = agree[j, i[sound]] * agree[j, k[sound]] / agree[i[sound], k[sound]]
    return float(np.sqrt(np.clip(np.median(squares), 0.02**2, 0.98**2)))


def _bits(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(VOTERS)[None, :]) & 1


def _presence(hits: pa.Array, width: int) -> np.ndarray:
    """Rows of 0 and 1 for lists of numbers, with a last column of ones."""
    out = np.zeros((len(hits), width + 1))
    rows = np.repeat(np.arange(len(hits)), np.diff(hits.offsets.to_numpy()))
    out[rows, hits.flatten().to_numpy()] = 1
    out[:, -1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _few_files(rows: DataFrame) -> DataFrame:
    """A written table in tasks of some ``ROWS_A_TASK`` rows, as it is read many times."""
    return rows.coalesce(rows.count() // ROWS_A_TASK + 1)


def train(rows: DataFrame, model: LabelModel, width: int) -> np.ndarray:
    """Weights of the entries and a constant, from (hits, votes, n) rows."""
    weights = np.zeros(width + 1)
    for _ in range(NEWTON_STEPS):

        def step(batch: pa.RecordBatch, weights=weights) -> np.ndarray:
            out = np.zeros((width + 1, width + 2))
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                x = _presence(pa.array(part.column(0).to_pylist(), pa.list_(pa.int32())), width)
                n = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                y = model.posterior(_bits(part.column(1).to_numpy(zero_copy_only=False)))
                p = _sigmoid(x @ weights)
                curve = n * np.maximum(p * (1 - p), 1e-6)
                out += np.hstack([(x * curve[:, None]).T @ x, (x.T @ (n * (y - p)))[:, None]])
            return out

        sums = partition_sums(rows, step, (width + 1, width + 2))
        penalty = np.full(width + 1, RIDGE)
        penalty[-1] = 1e-6
        move = np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1] - penalty * weights)
        move *= min(1.0, 4 / max(np.abs(move).max(), 1e-9))
        weights = weights + move
        if np.abs(move).max() < 1e-3:
            break
    return weights


def calibrate(rows: DataFrame, weights: np.ndarray, width: int) -> tuple[float, float]:
    """Slope and shift that fit the linear score to the labels of (hits, label, n) rows."""
    line = np.array([1.0, 0.0])
    for _ in range(NEWTON_STEPS):

        def step(batch: pa.RecordBatch, line=line) -> np.ndarray:
            out = np.zeros((2, 3))
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                x = _presence(pa.array(part.column(0).to_pylist(), pa.list_(pa.int32())), width) @ weights
                z = np.column_stack([x, np.ones(len(x))])
                y, n = (part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                p = _sigmoid(z @ line)
                curve = n * np.maximum(p * (1 - p), 1e-6)
                out += np.hstack([(z * curve[:, None]).T @ z, (z.T @ (n * (y - p)))[:, None]])
            return out

        sums = partition_sums(rows, step, (2, 3))
        move = np.linalg.solve(sums[:, :2] + 0.1 * np.eye(2), sums[:, 2] - 0.1 * (line - [1.0, 0.0]))
        move *= min(1.0, 2 / max(np.abs(move).max(), 1e-9))
        line = line + move
        if np.abs(move).max() < 1e-3:
            break
    return float(max(line[0], 0.05)), float(line[1])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, posterior of the label model."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels_of(labels, doc_id, label)
    lexicon = mine(texts, known)
    width, kind = lexicon.width, docs.schema[doc_id].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.hits(v) for v in utf8(batch.column(1))]
            hits, votes = pa.array([h for h, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), hits, votes], names=["doc_id", "hits", "votes"])

    voted = materialize(texts.mapInArrow(vote, f"doc_id {kind}, hits array<int>, votes long"), "toxicity-votes")
    training = voted.where(crc_bucket("doc_id", FOLDS) != HELD_OUT)
    rows = _few_files(materialize(training.groupBy("hits", "votes").agg(F.count("*").alias("n")), "toxicity-rows"))

    def together(batch: pa.RecordBatch) -> np.ndarray:
        bits = _bits(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
        n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
        return np.vstack([(bits * n[:, None]).T @ bits, np.full(VOTERS, n.sum())])

    pairs = partition_sums(rows, together, (VOTERS + 1, VOTERS))
    taught = training.join(known.withColumn("label", F.when(F.col("label") > 0.5, 1.0).otherwise(0.0)), "doc_id")
    taught = _few_files(materialize(taught.groupBy("hits", "label").agg(F.count("*").alias("n")), "toxicity-taught"))
    share = taught.agg(F.sum(F.col("label") * F.col("n")) / F.sum("n")).first()[0]
    prior = min(max(share if share is not None else 0.05, 0.005), 0.5)
    model = fit_label_model(pairs[:-1], pairs[-1, 0], prior)
    weights = train(rows, model, width)
    slope, shift = calibrate(taught, weights, width)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _presence(pa.array(batch.column(1).to_pylist(), pa.list_(pa.int32())), width)
            scores = _sigmoid(slope * (x @ weights) + shift)
            posterior = model.posterior(_bits(batch.column(2).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(posterior, pa.float64())], names=["doc_id", "score", "posterior"]
            )

    scored = voted.mapInArrow(score, f"doc_id {kind}, score double, posterior double")
    return scored.select(
        "doc_id",
        (crc_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        "posterior",
    )
