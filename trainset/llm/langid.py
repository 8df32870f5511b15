"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary n-gram classifier weighs how much likelier
an n-gram is in the languages with the bit than in those without. The margins of a text are compared
with every codeword by a loss that weighs each bit by how well it parts the languages; the nearest
codeword wins, and a text whose second-nearest is almost as near is flagged as ambiguous.

N-grams of 2 to 4 letters of lower-cased words, with word edges, are hashed into ``BUCKETS`` cells and
counted by language over all training rows; partitions count, and one table of languages by cells
comes out. A language counts the same however many of the rows it has.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if there is no training
row. With one language learned, that is the answer with score 1. A null language teaches nothing.
Ties go to the language that sorts first. Repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trainset.llm.common import as_text, crc_bucket

FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 14
BLOCK = 1 << 11  # cells that travel in one row
ENOUGH = 40  # n-grams after which more of the same say no more
SHARPNESS = 2.0
AMBIGUOUS = 0.2  # difference of the two least losses, of the whole weight of the bits
UNKNOWN = "und"
SEED = 11

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)
_ALPHABET: list[np.ndarray] = []


def _alphabet() -> np.ndarray:
    """Code point to itself if it is a letter, else 0; made once in a process."""
    if not _ALPHABET:
        _ALPHABET.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint32, 0x110000))
    return _ALPHABET[0]


def cells(text: str) -> np.ndarray:
    """The cells of all n-grams of a text; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _alphabet()[points]
    keep = letters > 0
    if not keep.any():
        return np.zeros(0, np.int64)
    keep[1:] |= keep[:-1]  # one edge after each word
    c = np.concatenate(([0], letters[keep], [0])).astype(np.uint64)
    out, mixed = [], c * _MULTIPLIERS[0]
    for n in (1, 2, 3):
        mixed = mixed[:-1] * np.uint64(31) + c[n:] * _MULTIPLIERS[n]
        inside = np.ones(len(mixed), bool)
        for k in range(1, n):  # n-grams do not go across words
            inside &= c[k : len(c) - n + k] > 0
        out.append(((mixed[inside] ^ (mixed[inside] >> np.uint64(15))) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - 14))
    return np.concatenate(out).astype(np.int64)


def code_book(languages: int) -> np.ndarray:
    """Codewords as rows of +1 and -1: all splits of up to 5 languages, else the best of seeded draws."""
    if languages <= 5:
        splits = [s for k in range(1, languages) for s in combinations(range(1, languages), k)]
        return np.array([[-1 if i in s else 1 for s in splits] for i in range(languages)]).reshape(languages, -1)
    rng = np.random.default_rng(SEED)
    length = max(15, 8 * int(np.ceil(np.log2(languages))))
    best, apart = None, -1
    for _ in range(200):
        book = np.where(rng.permuted(np.tile(np.arange(languages)[:, None], (1, length)), axis=0) < languages // 2, 1, -1)
        least = min(int((book[i] != book[j]).sum()) for i, j in combinations(range(languages), 2))
        if least > apart:
            best, apart = book, least
    return best


@dataclass
class Model:
    languages: list[str]
    book: np.ndarray  # languages x bits
    weights: np.ndarray  # cells x bits, margins in units of the usual margin of the bit
    trust: np.ndarray  # of each bit; they sum to 1

    def decode(self, found: np.ndarray) -> tuple[str, float, bool]:
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = self.weights[found].mean(axis=0) * min(1.0, np.sqrt(len(found) / ENOUGH))
        loss = np.log1p(np.exp(-SHARPNESS * self.book * margins)) @ self.trust
        first, second = np.argsort(loss, kind="stable")[:2]
        odds = np.exp(8 * (loss[first] - loss))
        return self.languages[first], float(odds[first] / odds.sum()), bool(loss[second] - loss[first] < AMBIGUOUS)


def build(counts: dict[str, np.ndarray]) -> Model:
    """Bit classifiers from the cell counts of each language."""
    languages = sorted(counts)
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    shares = np.array([(counts[x] + 0.1) / (counts[x].sum() + 0.1 * BUCKETS) for x in languages])
    book = code_book(len(languages))
    weights = np.empty((BUCKETS, book.shape[1]))
    trust = np.empty(book.shape[1])
    for bit, column in enumerate(book.T):
        w = np.log(shares[column > 0].mean(axis=0)) - np.log(shares[column < 0].mean(axis=0))
        means = shares @ w
        middle = (means[column > 0].min() + means[column < 0].max()) / 2
        usual = np.abs(means - middle).mean() or 1.0
        spread = np.sqrt(np.maximum(shares @ (w * w) - means * means, 1e-9)).mean()
        weights[:, bit] = (w - middle) / usual
        trust[bit] = usual / spread
    return Model(languages, book, weights, trust / trust.sum())


def count_cells(rows: DataFrame) -> dict[str, np.ndarray]:
    """Cell counts by language of (text, lang) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(as_text(batch.column(0)), batch.column(1).to_pylist()):
                table = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                table += np.bincount(cells(text), minlength=BUCKETS)
        for lang, table in seen.items():
            blocks = table.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(blocks), "block": pa.array(range(len(blocks)), pa.int32()), "n": pa.array(list(blocks), pa.list_(pa.int64()))}
            )

    def meet(group: pa.Table) -> pa.Table:
        total = np.array(group.column("n").to_pylist(), np.int64).sum(axis=0)
        return group.select(["lang", "block"]).slice(0, 1).append_column("n", pa.array([total], pa.list_(pa.int64())))

    schema = "lang string, block int, n array<long>"
    summed = rows.mapInArrow(count, schema).groupBy("lang", "block").applyInArrow(meet, schema)
    out: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator():  # languages x cells
        out.setdefault(row["lang"], np.zeros((BUCKETS // BLOCK, BLOCK)))[row["block"]] = row["n"]
    return {lang: table.ravel() for lang, table in out.items() if table.sum()}


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    teaching = docs.where((crc_bucket(doc_id, FOLDS) != HELD_OUT) & F.col(lang).isNotNull())
    model = build(count_cells(teaching.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # cells x bits, whatever the input

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.decode(cells(t)) for t in as_text(batch.column(1))]
            names, scores, flags = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    judged = docs.select(doc_id, text).mapInArrow(decode, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    return judged.select("doc_id", (crc_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")
