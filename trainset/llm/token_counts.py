"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair pieces.

The normaliser and the splitter never join what white space parts, so a text is the sum of its chunks
between white space. For a piece of a chunk the count of every prefix follows from shorter prefixes:
the encoding of a prefix ends in exactly one token ``t`` that may follow the last token of the prefix
without ``t``; so ``count[i] = count[i - len(t)] + 1``. Whether two tokens may follow each other is
found once with the merge ranks and remembered. Counts of a chunk are remembered too.

A stored row answers how many tokens the first n characters have (``tokens_at``) and how many
characters fit a budget (``prefix_within``) without encoding again.

Defined results: a null text counts as empty; an empty text has 0 tokens and the one prefix 0. Special
tokens inside texts count one each, as the library takes them. Repeated rows are counted one by one.
Columns other than those named are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trainset.llm.common import as_text, utf8

DEFAULT = "word_bpe_49k.json"
LIMIT = 2048
MEMORY = 400_000  # remembered chunks, pieces and token pairs of a worker, each; the least recent half goes first
SLICE = 1 << 20  # characters of text whose prefixes are in memory at once

_WHITE = "\t-\r \x85\xa0  -     　"  # white space of the splitter
_SPACE = re.compile(f"[{_WHITE}]+")
_CHUNK = re.compile(f"[^{_WHITE}]+")
_PYTHON_ONLY = re.compile("[\x1c-\x1f]")  # str.split() parts at these, the splitter does not
_CONTRACTIONS = {"'re", "'ve", "'ll"}


def tokenizer_file(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks_of(text: str) -> list[str]:
    return [c for c in _SPACE.split(text) if c] if _PYTHON_ONLY.search(text) else text.split()


class Pieces:
    """Counts of one piece at all its prefixes, by the merge ranks of the tokenizer."""

    def __init__(self, model: dict) -> None:
        self.vocabulary = set(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.longest = max(len(t.removesuffix(self.end)) if self.end else len(t) for t in self.vocabulary)
        self.pairs: dict[str, tuple[dict[str, bool], dict[str, bool]]] = {}
        self.known = 0

    def encode(self, symbols: list[str]) -> list[str]:
        """Merges the best-ranked neighbours until none is left."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), len(self.rank)))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            merged, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    merged.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    merged.append(symbols[i])
                    i += 1
            symbols = merged
        return symbols

    def followers(self, before: str) -> tuple[dict[str, bool], dict[str, bool]]:
        """What is known of tokens after ``before``: inside a word, and at its end."""
        known = self.pairs.get(before)
        if known is None:
            known = self.pairs[before] = ({}, {})
        return known

    def follows(self, before: str, token: str, last: bool) -> bool:
        """Whether the encoding of ``before`` + ``token`` is these two tokens."""
        symbols = [*before, *token]
        end = token
        if last:
            symbols[-1] += self.end
            end += self.end
        good = self.encode(symbols) == ([before, end] if before else [end])
        self.known += 1
        if self.known > MEMORY:
            self.known = 0
            self.pairs.clear()
        self.followers(before)[last][token] = good
        return good

    def inner(self, piece: str) -> tuple[list[int], list[str]]:
        """For each proper prefix, as the start of a longer word: its tokens and the last of them."""
        vocabulary, longest = self.vocabulary, self.longest
        counts, tails, after = [0], [""], [self.followers("")[0]]
        for i in range(1, len(piece)):
            for start in range(max(0, i - longest), i):
                token = piece[start:i]
                if token in vocabulary:
                    good = after[start].get(token)
                    if good is None:
                        good = self.follows(tails[start], token, False)
                    if good:
                        counts.append(counts[start] + 1)
                        tails.append(token)
                        after.append(self.followers(token)[0])
                        break
        return counts, tails

    def whole(self, piece: str, i: int, counts: list[int], tails: list[str]) -> int:
        """Tokens of the first ``i`` symbols, taken as a whole word."""
        for start in range(max(0, i - self.longest), i):
            token = piece[start:i]
            if token + self.end in self.vocabulary:
                good = self.followers(tails[start])[1].get(token)
                if good or good is None and self.follows(tails[start], token, True):
                    return counts[start] + 1
        raise ValueError("the vocabulary does not hold all single symbols")

    def total(self, piece: str) -> int:
        return self.whole(piece, len(piece), *self.inner(piece))

    def counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of 1, 2, ... symbols, taken as a whole word."""
        table = self.inner(piece)
        return [self.whole(piece, i, *table) for i in range(1, len(piece) + 1)]


class Recent(dict):
    """Remembers what ``make`` returned for the latest keys, ``MEMORY`` to twice as many."""

    def __init__(self, make: Callable[[str], int]) -> None:
        super().__init__()
        self.make = make
        self.old: dict[str, int] = {}

    def __missing__(self, key: str) -> int:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_letters() -> dict[int, int]:
    """Byte-level letters: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip((b for b in range(256) if b not in plain), range(256, 512))) | {b: b for b in plain}


class PrefixCounter:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = Pieces(spec["model"])
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None
        self.letters = byte_letters()
        self.piece_totals = Recent(self.pieces.total)
        self.chunk_totals = Recent(self.chunk_total)

    def chunk_total(self, chunk: str) -> int:
        word, mark = (chunk[:-1], 1) if chunk[-1] in ".,!?;:" else (chunk, 0)
        if word.isalpha() and unicodedata.is_normalized("NFC", word) and not ("\u0130" in word or "\u03a3" in word):
            return self.piece_totals[word.lower().encode().decode("latin-1").translate(self.letters)] + mark
        return sum(self.piece_totals[piece] for piece, _ in self.split(chunk))

    def split(self, chunk: str) -> list[tuple[str, tuple[int, int]]]:
        return self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text between special tokens, and these."""
        if self.special is None or "<|" not in text:
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def total(self, text: str) -> int:
        totals = self.chunk_totals
        return sum(1 if special else sum(map(totals.__getitem__, chunks_of(part))) for part, special in self.parts(text))

    def of_chunk(self, chunk: str) -> list[int]:
        """Tokens of each prefix of 1, 2, ... characters of a chunk."""
        pieces = self.split(chunk)
        normal = self.library.normalizer.normalize_str(chunk)
        if len(normal) != len(chunk) or not chunk.isascii() and any(
            len(self.library.normalizer.normalize_str(c)) != 1 for c in chunk
        ):  # characters that join or come apart: each prefix on its own
            return [sum(self.piece_totals[p] for p, _ in self.split(chunk[:i])) for i in range(1, len(chunk) + 1)]
        out, before = [], 0
        for piece, (first, end) in pieces:
            counts, at = self.pieces.counts(piece), 0
            for i, c in enumerate(normal[first:end]):
                at += len(c.encode())
                broken = piece in _CONTRACTIONS and i == 1  # 'r is a sign and a letter, 're one piece
                out.append(before + (2 if broken else counts[at - 1]))
            before += counts[-1]
        return out

    def prefixes(self, text: str) -> list[int]:
        """Tokens of the first 0, 1, 2, ... characters."""
        out = [0]
        for part, special in self.parts(text):
            if special:  # cut short, it is ordinary text
                before = out[-1]
                out += [before + n for n in self.of_chunk(part[:-1])] + [before + 1]
                continue
            at = 0
            for m in _CHUNK.finditer(part):
                before = out[-1]
                out += [before] * (m.start() - at)
                out += [before + n for n in self.of_chunk(m[0])]
                at = m.end()
            out += [out[-1]] * (len(part) - at)
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(name: str) -> PrefixCounter:
    """One per worker process; the tokenizer is part of the installation on every machine."""
    if name not in _COUNTERS:
        _COUNTERS[name] = PrefixCounter(tokenizer_file(name))
    return _COUNTERS[name]


def count_tokens(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT, limit: int = LIMIT
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens (the count at the whole prefix), over_limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = counter(tokenizer).total
        for batch in batches:
            values = utf8(batch.column(1))
            tokens = [total(v.decode()) for v in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, values), pa.int64()), pa.array(tokens, pa.int64()), pa.array((n > limit for n in tokens), pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def store_prefix_counts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT
) -> DataFrame:
    """doc_id and ``counts``: the tokens of the first 0, 1, 2, ... characters of the text."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(tokenizer).prefixes
        for batch in batches:
            texts, first, size = as_text(batch.column(1)), 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size >= SLICE or end == len(texts):
                    counts = pa.array([prefixes(t) for t in texts[first:end]], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), counts], names=["doc_id", "counts"])
                    first, size = end, 0

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(store, f"doc_id {kind}, counts array<int>")


def tokens_at(counts: Column, characters: Column | int) -> Column:
    """Tokens of the first ``characters`` characters; of the whole text, if it is shorter."""
    n = F.lit(characters) if isinstance(characters, int) else characters
    return F.element_at(counts, F.least(n.cast("int"), F.size(counts) - 1) + 1)


def prefix_within(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(counts, lambda n, i: F.when(n <= b, i))
    return F.array_max(fits)
