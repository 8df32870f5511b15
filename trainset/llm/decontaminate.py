"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all test items go into one automaton (a block of items each, if there are
very many). Training texts are streamed through it word by word; the automaton tracks the length of
the longest match that ends at the current word. A match of ``window`` words or more is a hit of all
items that hold its last ``window`` words; an item shorter than the window hits where it occurs whole.

Words are the runs of letters, digits and non-ASCII characters after lower-casing A-Z.

Defined results: a null or empty text has no words, no hits and is not contaminated. Items without
words or with null text are never found; a null item id is written as an empty id; repeated item ids
count once. Repeated documents are judged one by one. Columns other than those named are not read by
``find_contamination``; ``drop_contaminated``, ``cut_spans`` and ``remove_contamination`` keep every column of the table as it is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from trainset.llm.common import materialize, packed, utf8

WINDOW = 13
COVERAGE = 20  # contaminated from one hit word in so many
BLOCK_WORDS = 200_000  # words of test items in one automaton: some 200 MB in a Python worker

_SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else (32 if b < 128 and _SEPARATOR.match(bytes([b])) else b) for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # before lower-casing


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with what each state tells about the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.whole: dict[int, set[str]] = {}  # state -> items shorter than the window that it spells
        ends: dict[int, set[str]] = {}
        number = self.vocabulary.setdefault
        for item, words in items:
            state = 0
            for word in words:
                state = self._extend(state, number(word, len(self.vocabulary)))
                if len(words) >= window and self.length[state] >= window:
                    ends.setdefault(state, set()).add(item)
            if 0 < len(words) < window:
                self.whole.setdefault(state, set()).add(item)
        self._summarise(ends)

    def _new(self, steps: dict[int, int], link: int, length: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.steps) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """A copy of ``child`` for the strings no longer than one word after ``parent``."""
        copy = self._new(dict(self.steps[child]), self.link[child], self.length[parent] + 1)
        self.link[child] = copy
        while parent >= 0 and self.steps[parent].get(word) == child:
            self.steps[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.steps[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._new({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.steps[at]:
            self.steps[at][word] = new
            at = self.link[at]
        if at >= 0:
            child = self.steps[at][word]
            self.link[new] = child if self.length[child] == self.length[at] + 1 else self._split(at, word, child)
        return new

    def _summarise(self, ends: dict[int, set[str]]) -> None:
        """Items below each state that spells a window, and the nearest short item on each suffix path."""
        order = sorted(range(1, len(self.steps)), key=self.length.__getitem__, reverse=True)
        for state in order:
            up = self.link[state]
            if state in ends and self.length[up] >= self.window:
                ends.setdefault(up, set()).update(ends[state])
        self.spelled = [-1] * len(self.steps)
        self.short = [-1] * len(self.steps)
        for state in reversed(order):
            up = self.link[state]
            self.short[state] = state if state in self.whole else self.short[up]
            if self.length[state] >= self.window:
                self.spelled[state] = state if self.length[up] < self.window else self.spelled[up]
        self.items = {s: ends[s] for s in set(self.spelled) if s >= 0}

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (first, past the last; overlaps allowed) and the items found."""
        steps, link, length, short, window = self.steps, self.link, self.length, self.short, self.window
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = matched = at = 0
        for word in map(self.vocabulary.get, words):
            at += 1
            if word is None:
                state = matched = 0
                continue
            step = steps[state].get(word)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = steps[state].get(word)
            if step is None:
                continue
            state = step
            matched += 1
            if matched >= window:
                spans.append((at - window, at))
                found |= self.items[self.spelled[state]]
            item = short[state]
            if item >= 0:
                if item == state and matched < length[state]:
                    item = short[link[state]]
                while item >= 0:
                    spans.append((at - length[item], at))
                    found |= self.whole[item]
                    item = short[link[item]]
        return spans, found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, block_words: int) -> list[Broadcast]:
    """The distinct items in blocks of a bounded number of words.

    A block is sent as its texts, less than 1 MB at the default size; the tasks build the automaton.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")
    ).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // (4 * block_words)) or 1
    items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "benchmark-items")
    shared = []
    for number in range(blocks):
        rows = items.where(F.col("block") == number).collect()  # about 4 * block_words characters
        shared.append(spark.sparkContext.broadcast((uuid.uuid4().hex, window, sorted((r["item"], r["text"]) for r in rows))))
    return shared


_BUILT: dict[str, Automaton] = {}


def _automaton(block: tuple[str, int, list[tuple[str, str]]]) -> Automaton:
    """The block's automaton, built once in a Python worker, which keeps only the last one."""
    name, window, rows = block
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton([(item, words_of(text.encode())) for item, text in rows], window)
    return _BUILT[name]


def _searched(docs: DataFrame, text: str, blocks: list[Broadcast], keep_row: bool) -> DataFrame:
    """``docs`` (a column, and a struct or string that holds the text) with ``found``: words, spans, items.

    With several blocks the documents pass through one after the other and are written in between,
    so that a Python worker holds one automaton at a time.
    """
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    result = StructField("found", StructType.fromDDL("n_words long, spans array<int>, items array<string>"))
    names, fields = docs.columns, docs.schema.fields
    out = docs
    for number, block in enumerate(blocks):
        if number:
            out = materialize(out, "contamination")

        def search(batches: Iterator[pa.RecordBatch], block=block, first=number == 0) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block.value)
            for batch in batches:
                cells = []
                before = None if first else batch.column(len(names)).to_pylist()
                texts = batch.column(0).field(text) if keep_row else batch.column(1)
                for i, value in enumerate(utf8(texts)):
                    words = words_of(value)
                    spans, items = automaton.search(words)
                    if before:
                        old = before[i]["spans"]
                        spans += zip(old[::2], old[1::2])
                        items |= set(before[i]["items"])
                    flat = [x for span in joined(spans) for x in span]
                    cells.append({"n_words": len(words), "spans": flat, "items": sorted(items)})
                columns = [*batch.columns[: len(names)], pa.array(cells, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "found"])

        out = out.mapInArrow(search, StructType([*fields, result]))
    return out.select(names[0], "found")


def _hit() -> Column:
    """Hit words: ends less starts of the spans."""
    spans = F.col("found.spans")
    ends = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("s")), lambda a, x: F.struct((a["n"] + a["s"] * x).alias("n"), (-a["s"]).alias("s")))
    return ends["n"].cast("long")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: words, hit words, spans of them, items found and the verdict.

    ``contaminated``: at least one hit word, and at least one in ``coverage`` words is hit.
    """
    blocks = _blocks(benchmark, item_id, item_text, window, block_words)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hit = _hit()
    return _searched(texts, "text", blocks, keep_row=False).select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        F.col("found.items").alias("items"),
        F.col("found.spans").alias("spans"),
        ((hit > 0) & (hit * coverage >= F.col("found.n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents that are not contaminated, whole and with all their columns."""
    blocks = _blocks(benchmark, item_id, item_text, window, block_words)
    found = _searched(packed(docs), text, blocks, keep_row=True)
    hit = _hit()
    return found.where((hit == 0) | (hit * coverage < F.col("found.n_words"))).select("row.*")


def cut_spans(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_span: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns, the text without its spans of ``max_span`` hit words or more.

    Documents of which more than ``max_coverage`` of the words are hit are dropped.
    """
    blocks = _blocks(benchmark, item_id, item_text, window, block_words)
    found = _searched(packed(docs), text, blocks, keep_row=True)
    hit = _hit()
    kept = found.where((hit == 0) | (hit <= F.lit(max_coverage) * F.col("found.n_words")))
    return _cut(kept, text, max_span, None).select("row.*")


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", n_chars: str | None = None, item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, coverage: int = COVERAGE, max_span: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """What may be trained on: contaminated documents go, the others lose their spans of ``max_span`` hit words or more.

    All columns stay; ``n_chars`` names a column that takes the new length of a text that was cut. The words
    on both sides of a cut may form a new span, so texts that were cut are searched again until none is left:
    no kept text holds such a span. With one block of items a task does that row by row, in one pass; with
    several, a text must meet them all before it is cut, and every round works on the texts cut in the one before.
    """
    blocks = _blocks(benchmark, item_id, item_text, window, block_words)
    if len(blocks) == 1:
        return _cleaned(packed(docs), text, blocks[0], coverage, max_span, n_chars).select("row.*")
    hit = _hit()
    found = _searched(packed(docs), text, blocks, keep_row=True)
    todo = found.where((hit == 0) | (hit * coverage < F.col("found.n_words")))
    clean: DataFrame | None = None
    while True:
        cut = materialize(_cut(todo, text, max_span, n_chars), "cut-texts")
        done = cut.where(~F.col("cut")).select("row")
        clean = done if clean is None else clean.unionAll(done)
        again = cut.where("cut").select("row")
        if again.isEmpty():
            return clean.select("row.*")
        todo = _searched(again, text, blocks, keep_row=True)


def _cleaned(rows: DataFrame, text: str, block: Broadcast, coverage: int, least: int, n_chars: str | None) -> DataFrame:
    """``rows`` (a struct ``row``) that are not contaminated, their texts cut until no span of ``least`` words is left."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block.value)
        for batch in batches:
            row = batch.column(0)
            keep, new = [], {}
            for i, value in enumerate(utf8(row.field(text))):
                words = words_of(value)
                spans = joined(automaton.search(words)[0])
                hit = sum(end - first for first, end in spans)
                keep.append(hit == 0 or hit * coverage < len(words))
                if keep[-1] and _has_long(spans, least):
                    new[i] = value.decode()
                    while _has_long(spans, least):
                        new[i] = _without(new[i], spans, least)
                        spans = joined(automaton.search(words_of(new[i].encode()))[0])
            yield pa.RecordBatch.from_arrays([_replaced(row, text, new, n_chars)], names=["row"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(clean, rows.schema)


def _has_long(spans: list[tuple[int, int]], least: int) -> bool:
    return any(end - first >= least for first, end in spans)


def _replaced(row: pa.StructArray, text: str, new: dict[int, str], n_chars: str | None) -> pa.StructArray:
    """``row`` with the new texts of some of its rows, and their lengths."""
    if not new:
        return row
    columns = row.flatten()
    for name, change in ((text, new), (n_chars, {i: len(t) for i, t in new.items()})):
        if name is not None:
            at = row.type.get_field_index(name)
            values = columns[at].to_pylist()
            for i, value in change.items():
                values[i] = value
            columns[at] = pa.array(values, columns[at].type)
    return pa.StructArray.from_arrays(columns, fields=list(row.type))


def _cut(found: DataFrame, text: str, least: int, n_chars: str | None) -> DataFrame:
    """(row, cut): rows without their spans of ``least`` words or more, and whether there was one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = row.field(text)
            spans = [list(zip(x["spans"][::2], x["spans"][1::2])) for x in batch.column(1).to_pylist()]
            new = {i: _without(texts[i].as_py(), s, least) for i, s in enumerate(spans) if _has_long(s, least)}
            was_cut = pa.array([i in new for i in range(len(spans))], pa.bool_())
            yield pa.RecordBatch.from_arrays([_replaced(row, text, new, n_chars), was_cut], names=["row", "cut"])

    return found.mapInArrow(cut, StructType([found.schema["row"], StructField("cut", BooleanType())]))


def _without(text: str, spans: list[tuple[int, int]], least: int) -> str:
    words = [m.span() for m in _WORD.finditer(text)]
    out, start = [], 0
    for first, end in spans:
        if end - first >= least:
            out.append(text[start : words[first][0]])
            start = words[end - 1][1]
    return "".join([*out, text[start:]])
