"""Phrase collocations by prefix-free parsing.

A text is a run of words and breaks (a break stands for any run of separators; phrases do not cross it). A
parse cuts the run where two neighbouring tokens' mark is a multiple of ``EVERY``: where a chunk ends depends
on what is there, so equal passages give equal chunks wherever they stand. Each chunk goes on
for ``longest`` - 1 tokens into the next, and a phrase belongs to the chunk in whose own part it starts: it is
counted once and never lost. The dictionary holds each distinct chunk of a language with its frequency in the
parse; everything after works on the dictionary, each phrase of a chunk weighted by that frequency, so a
passage that a third of the documents share is counted in one row.

Only phrases seen ``least`` times matter, and so do their parts. So the dictionary is read once a length: words
first, then by 64-bit hash the phrases whose two shorter parts may be frequent. Which may be is told by a bitmap of
``BITS`` bits over hashes; a false hit costs time only. The last reading counts the phrases that are left by
their words. Inside a task's held counts words and phrases are told apart by 64-bit hashes, then by themselves.

Scores are exact: products are 38-digit decimals, right up to 10 ** 16 occurrences.

Defined results: a null text is empty, a null language is ``und`` (with real ``und`` texts in one group). Repeated
rows and copies count as often as they occur. A language without candidates gives no rows. Ties are all ordered.
Document ids and other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from trainset.llm.common import materialize
from trainset.llm.hotkeys import join_hot
from trainset.llm.wordhash import LOWER, Hashes, joined, segments

LONGEST = 3
LEAST = 10
INSIDE = 50  # percent of a phrase's occurrences inside a longer candidate that drop it
TOP = 2000
EVERY = 32  # one token in so many starts a chunk
BITS = 1 << 27
PENDING = 1 << 20  # distinct counts a task holds before it passes them on
PARTS = 64  # of a language's phrases, ranked apart first

_GAP = re.compile(rb"[.,;:!?\x0a-\x0d\x20\x09]")
BREAK = b"."
_MARKED = bytes(ord(BREAK) if c in b".,;:!?\x0a\x0b\x0c\x0d" else LOWER[c] for c in range(256))


# ---------------------------------------------------------------- the parse


def tokens_of(text: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text, a segment of it at a time."""
    for segment in segments(text.translate(_MARKED), _GAP):
        yield segment.replace(b"..", b".").replace(b".", b" . ").split()


def parse(text: bytes, hashes: Hashes | Marks, overlap: int) -> Iterator[tuple[bytes, int]]:
    """Chunks of a text, words joined by spaces, with the number of tokens in their own part."""
    kept: list[bytes] = []
    for more in tokens_of(text):
        kept += more
        starts = _starts(hashes.of(kept))
        starts = starts[starts + max(overlap, 1) < len(kept)]  # the rest may go on in the next segment
        first = 0
        for start in starts.tolist():
            yield b" ".join(kept[first : start + overlap]), start - first
            first = start
        kept = kept[first:]
    if kept:
        yield b" ".join(kept), len(kept)


class Marks:
    """Marks of words for the parse: their length, first and last 8 bytes, mixed. Equal words have equal marks."""

    _KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        line = b" ".join(words) + b" " + bytes(8)
        ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = np.append(0, ends[:-1] + 1)
        size = ends - starts
        eight = np.ndarray(len(line) - 7, "<u8", line, strides=(1,))
        kept = self._KEPT[np.minimum(size, 8)]
        return joined(joined(eight[starts] & kept, eight[np.maximum(ends - 8, starts)] & kept), size.astype(np.uint64))


def _starts(h: np.ndarray) -> np.ndarray:
    """Positions, the first left out, at which a chunk starts."""
    return np.flatnonzero(joined(h[1:-1], h[2:]) % np.uint64(EVERY) == 0) + 1 if len(h) > 2 else np.zeros(0, np.int64)


def dictionary(docs: DataFrame, text: str, lang: str, longest: int) -> DataFrame:
    """(lang, chunk, own, n): distinct chunks, the tokens of their own part, and how often they occur in the parse."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = Marks(), Counter()
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for chunk, own in parse(value.as_py() or b"", marks, longest - 1):
                    seen[name, chunk, own] += 1
                    if len(seen) >= PENDING // 16:
                        yield _pairs(seen)
                        seen = Counter()
        yield _pairs(seen)

    def _pairs(seen: Counter) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([k[0] for k in keys], pa.string()), "chunk": pa.array([k[1] for k in keys], pa.binary()),
                "own": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array(list(seen.values()), pa.int64()),
            }
        )

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.encode(F.col(text), "UTF-8").alias("text"))
    cuts = rows.mapInArrow(cut, "lang string, chunk binary, own int, n long")
    return cuts.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- phrases of the dictionary


class Phrases:
    """The phrases of a batch of chunks, by length.

    The tokens are one run, ``words`` by ``code``, with a break between chunks; ``weight`` and ``lang`` tell each
    place's frequency and language.
    """

    def __init__(self, batch: pa.RecordBatch) -> None:
        from xxhash import xxh64_intdigest

        lists = pc.split_pattern(pc.binary_join_element_wise(batch.column(1).cast(pa.string()), BREAK.decode(), " "), " ")
        coded = lists.flatten().dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        names = batch.column(0).to_pylist()
        self.langs = sorted(set(names))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.repeat(np.fromiter(map(number.__getitem__, names), np.int64, len(names)), sizes)
        self.weight = np.repeat(batch.column(3).to_numpy(), sizes)
        self.h = _hashes(self.words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())[self.code]
        starts = np.cumsum(sizes) - sizes
        own = np.arange(len(self.h)) < np.repeat(starts + batch.column(2).to_numpy(), sizes)
        self.starts = own & (self.h != 0)
        # A language has hashes of its own: the first word's hash is mixed with it.
        seeds = np.array([xxh64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)
        self.one = np.where(self.h != 0, self.h ^ seeds[self.lang], np.uint64(0))

    def of_length(self, longest: int, maps: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the hash at each place and the places of phrases that may be frequent.

        ``maps`` are the bitmaps of the frequent phrases of one word, two words, and so on; a phrase may be
        frequent if its two shorter parts may be, and if it is in its own map, where there is one.
        """
        level, may = self.one, self.h != 0
        for k in range(1, longest + 1):
            if k > 1:
                longer = np.zeros(len(level), np.uint64)
                longer[: len(level) - k + 1] = joined(level[: len(level) - k + 1], self.h[k - 1 :])
                level, may = longer, np.append(may[:-1] & may[1:], False)
            if k <= len(maps):
                some = np.flatnonzero(may)
                may = np.zeros(len(may), bool)
                may[some[_may_be(maps[k - 1], level[some])]] = True
            yield k, level, np.flatnonzero(may & self.starts)


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of distinct words, 0 for a break only. Few of them come again soon, so none are remembered."""
    from xxhash import xxh64_intdigest

    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    h[h == 0] = 1
    if BREAK in words:
        h[words.index(BREAK)] = 0
    return h


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)


def _may_be(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bit(h)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def frequent(chunks: DataFrame, words: int, maps: list[np.ndarray], least: int) -> DataFrame:
    """(h): hashes of phrases of so many words, counted ``least`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in _pieces(batch):
                found = Phrases(piece)
                *_, (_, h, at) = found.of_length(words, maps)
                held.append((h[at], found.weight[at]))
                size += len(at)
                if size >= 8 * PENDING:
                    yield _sums(held)
                    held, size = [], 0
        if held:
            yield _sums(held)

    rows = chunks.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return rows.where(F.col("n") >= least).select("h")


def _pieces(batch: pa.RecordBatch, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the sums of ``n``."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
    return ranked[first], order[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def _sums(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, _, sums = _summed(np.concatenate([h for h, _ in held]), np.concatenate([n for _, n in held]))
    return pa.RecordBatch.from_pydict({"h": pa.array(keys.view(np.int64), pa.int64()), "n": pa.array(sums, pa.int64())})


def bitmap(hashed: DataFrame) -> np.ndarray:
    """Bits of the hashes ``h``, BITS / 8 bytes whatever their number, gathered from at most BITS / 64 rows."""
    place = F.shiftrightunsigned("h", 64 - (BITS.bit_length() - 1))
    bits = hashed.select(place.alias("p")).selectExpr("cast(p >> 6 as int) AS at", "shiftleft(1L, cast(p & 63 as int)) AS bit")
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def word_hashes(words: DataFrame) -> DataFrame:
    """(h): hashes of words of languages as ``Phrases`` has them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            seeds = np.fromiter((xxh64_intdigest(x.encode(), 1) for x in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            h = _hashes([w.encode() for w in batch.column(1).to_pylist()]) ^ seeds
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64), pa.int64())})

    return words.select("lang", "phrase").mapInArrow(add, "h long")


def count_phrases(chunks: DataFrame, lengths: tuple[int, ...], maps: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, f) of the phrases of some lengths that may be frequent, counted by their words.

    Occurrences are put together by 64-bit hash while up to PENDING counts of batches are held, then by the words
    themselves.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in _pieces(batch):
                found = Phrases(piece)
                for k, h, at in found.of_length(max(lengths), maps):
                    if k in lengths:
                        keys, first, sums = _summed(h[at], found.weight[at])
                        places = at[first]
                        words = [found.words.take(pa.array(found.code[places + i])) for i in range(k)]
                        langs = pa.array(found.langs, pa.string()).take(pa.array(found.lang[places]))
                        phrase = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0]
                        held.append((keys, langs, phrase, sums))
                        size += len(keys)
                if size >= PENDING:
                    yield merged(held)
                    held, size = [], 0
        if held:
            yield merged(held)

    def merged(held: list[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        keys, langs, phrases, sums = zip(*held)
        _, first, sums = _summed(np.concatenate(keys), np.concatenate(sums))
        at = pa.array(first)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(langs).take(at), pa.concat_arrays(phrases).take(at), pa.array(sums, pa.int64())], names=["lang", "phrase", "f"])

    return chunks.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


# ---------------------------------------------------------------- scores


def _words(c: str = "phrase") -> Column:
    return F.split(c, " ")


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of 2 to ``longest`` words of each language."""
    chunks = materialize(dictionary(docs, text, lang, longest), "phrases-dictionary")
    words = materialize(count_phrases(chunks, (1,), []), "phrases-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    maps = [bitmap(word_hashes(words.where(F.col("f") >= least)))]
    for k in range(2, longest + 1):
        maps.append(bitmap(frequent(chunks, k, list(maps), least)))
    phrases = materialize(count_phrases(chunks, tuple(range(2, longest + 1)), maps).where(F.col("f") >= least), "phrases-counted")
    counts = words.where(F.col("f") >= least).unionByName(phrases)

    # Every cut of a phrase into a first part and the rest
    size = F.size(_words())
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    part = lambda start, length: F.array_join(F.slice(_words(), start, length), " ")
    cuts = cuts.withColumn("first", part(1, F.col("k"))).withColumn("rest", part(F.col("k") + 1, size))
    cuts = join_hot(cuts, counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = join_hot(cuts, counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    big = "cast({0} as decimal(19,0))".format
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * {big('a')} * {big('a')}) div ({big('l')} * {big('r')})")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least_cut).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    # Phrases that mostly stand inside a longer candidate go
    inner = phrases.where(size > 2).select("lang", F.col("f").alias("longer"), _words().alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda s: F.array_join(F.slice("w", s, m), " "))))
    inner = inner.select("lang", "longer", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))

    # The first of each part, then the first of these: no task ranks more than PARTS times ``top`` phrases of a language.
    best = [F.desc("score"), F.desc("a"), "phrase"]
    parted = free.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    ranked = parted.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """DuckDB SQL for ``collocations`` with its default parameters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
    s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    g AS (SELECT lang, unnest([w[i:i + m - 1] FOR m IN range(1, least({LONGEST}, len(w) - i + 1) + 1)]) AS g FROM s),
    f AS (SELECT lang, g, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY lang, g),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
    c AS (SELECT * FROM f WHERE len(g) > 1 AND f >= {LEAST}),
    k AS (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM c),
    cut AS (SELECT k.lang, k.g, k.f AS a, x.f AS l, y.f AS r, k,
        CAST(1000000::HUGEINT * k.f * k.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
        FROM k JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k + 1:]),
    best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    longer AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM c WHERE len(g) = 3),
    inner_max AS (SELECT lang, g, max(f) AS f FROM longer GROUP BY lang, g),
    free AS (SELECT b.* FROM best b LEFT JOIN inner_max i ON i.lang = b.lang AND i.g = b.g WHERE i.f IS NULL OR 100 * i.f < {INSIDE} * b.a)
    SELECT * FROM (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS BIGINT) AS rank,
        array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM free JOIN n USING (lang)) WHERE rank <= {TOP}"""
