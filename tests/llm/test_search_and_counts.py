"""Collocations, hard negatives and the Jaccard join against brute force, and their edge cases."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import SF, rows_of
from pyspark.sql import functions as F

from trainset.llm import collocations, hotkeys, jaccard, negatives
from trainset.llm.wordhash import LOWER, Hashes


def lowered(text):
    return (text or "").encode().translate(LOWER)


# ---------------------------------------------------------------- collocations


def slow_collocations(rows, least=10, inside=50, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", lowered(text)):
            w = [x.decode() for x in re.findall(rb"[^\x20\x09]+", piece)]
            for i in range(len(w)):
                for m in range(1, min(3, len(w) - i) + 1):
                    f[lang if lang is not None else "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        kept = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in kept.items():
            if any(100 * b >= inside * a for h, b in kept.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))):
                continue
            score, _, l, r = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


ODD_TEXTS = [
    ("en", "Red Hot. red hot; RED HOT red hot sauce\tred hot sauce\nred  hot!sauce red" * 4),
    (None, "a a a a a a a a a a a a a a a"), ("und", "a a a a"), ("en", None), ("en", ""), ("de", ".,;"), ("fr", "\x0b\x0c x\x0by x y x y"),
    ("en", "red hot sauce. red hot sauce. Ünder öl ünder öl Ünder öl"), ("en", "red hot sauce. red hot sauce. Ünder öl ünder öl Ünder öl"),
]


def test_collocations_equal_brute_force(spark, documents, odd):
    for df in (documents, odd):
        assert rows_of(collocations.collocations(df)) == slow_collocations([(r["lang"], r["text"]) for r in df.collect()])
    df = spark.createDataFrame(ODD_TEXTS, "lang string, text string").repartition(3)
    for least in (2, 4):
        assert rows_of(collocations.collocations(df, least=least, top=7)) == slow_collocations(ODD_TEXTS, least, 50, 7)


def test_collocations_of_nothing(spark, empty):
    df = collocations.collocations(empty)
    assert df.collect() == [] and df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_parse_counts_each_phrase_once_and_cuts_by_content(monkeypatch):
    rng = np.random.default_rng(4)
    words = [b"w%d" % i for i in rng.zipf(1.4, 4000) % 500]
    hashes = Hashes({collocations.BREAK: 0})
    for segment in (1 << 20, 97):
        monkeypatch.setattr("trainset.llm.wordhash.SEGMENT", segment)
        chunks = list(collocations.parse(b" ".join(words), hashes, 2))
        assert sum(own for _, own in chunks) == len(words)
        counted = Counter()
        for chunk, own in chunks:
            w = chunk.split()
            for i in range(own):
                for m in (1, 2, 3):
                    if i + m <= len(w):
                        counted[b" ".join(w[i : i + m])] += 1
        assert counted == Counter(b" ".join(words[i : i + m]) for m in (1, 2, 3) for i in range(len(words) - m + 1))
    # A passage in other surroundings gives the same inner chunks
    a, b = (list(collocations.parse(b" ".join([x] * 9 + words), hashes, 2)) for x in (b"left", b"right"))
    assert len(set(a) & set(b)) > 0.9 * len(set(a))


def test_parse_by_marks_cuts_by_content():
    rng = np.random.default_rng(6)
    words = [b"%d" % 7 ** int(i) for i in rng.zipf(1.4, 3000) % 40] + [b"\xc3\xa4", collocations.BREAK, b"x"]
    marks = collocations.Marks()
    each = {w: int(marks.of([w])[0]) for w in words}
    assert marks.of(words).tolist() == [each[w] for w in words] and len(set(each.values())) == len(each)
    chunks = list(collocations.parse(b" ".join(words), marks, 2))
    assert len(chunks) > 30 and sum(own for _, own in chunks) == len(words)
    assert b" ".join(w for chunk, own in chunks for w in chunk.split()[:own]) == b" ".join(words)


def test_words_of_many_batches_are_counted_in_one_row_a_task(spark):
    """Batches of one row: a task holds its counts and passes each word on once."""
    rows = [("en", b"the same words", 3, 1)] * 30 + [("de", b"the same", 2, 5)]
    chunks = spark.createDataFrame(rows, "lang string, chunk binary, own int, n long").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        counted = collocations.count_phrases(chunks, (1,), [])
        found = sorted(tuple(r) for r in counted.collect())
        plan = counted._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == [("de", "same", 5), ("de", "the", 5), ("en", "same", 30), ("en", "the", 30), ("en", "words", 30)]
    assert rows_out_of(plan, "MapInArrow") == 5


def rows_out_of(plan, node):
    """Rows that the nodes of this name gave in a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return rows_out_of(plan.executedPlan(), node)
    if name.endswith("QueryStage"):
        return rows_out_of(plan.plan(), node)
    children = plan.children()
    own = plan.metrics().apply("pythonNumRowsReceived").value() if name == node else 0
    return own + sum(rows_out_of(children.apply(i), node) for i in range(children.size()))


# ---------------------------------------------------------------- hard negatives


def slow_negatives(rows):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) if abs(x) < 1e300 else 1 << 300 for x in v]
        if sum(x * x for x in whole) >= 2**63:
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, whole)
        best[i] = min(best.get(i, row), row)
    lengths = Counter(len(v) for _, v in best.values())
    usual = max(lengths, key=lambda n: (lengths[n], -n), default=0)
    best = {i: r for i, r in best.items() if len(r[1]) == usual}
    out = []
    for a, (label, v) in best.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fits = [(-t, i) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fits[:10])]
    return sorted(out, key=repr)


def test_packed_scores_are_exact():
    rng = np.random.default_rng(1)
    for high in (1, 5, 300, 2**20, 2**29):
        a, b = rng.integers(-high, high, (5, 9), endpoint=True), rng.integers(-high, high, (negatives.PACK + 70, 9), endpoint=True)
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert negatives.packed_scores(a, b).tolist() == want


def test_negatives_equal_brute_force(spark):
    real = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    assert rows_of(negatives.mine(real)) == slow_negatives([tuple(r) for r in real.collect()])
    assert rows_of(negatives.mine(real, row_block=40, anchor_block=2)) == rows_of(negatives.mine(real))


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 9, 4) / 8], int(rng.integers(0, 3)) if i % 3 else 1) for i in range(320)]
    rows += rows[:40] + [(200, [1.0, 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 1), (900, None, 1), (901, [1.0] * 4, None), (902, [1.0, None, 1.0, 1.0], 1)]
    rows += [(1000, [float("nan")] * 4, 1), (1100, [float("inf"), 0.0, 0.0, 0.0], 1), (1200, [], 1), (1300, [1.0, 2.0], 1), (1400, [0.0] * 4, 1)]
    rows += [(1500, [1e200] * 4, 1), (1600, [1e308] * 4, 1), (1700, [-5e6, 4e6, 3e6, 1e6], 1), (1701, [-5e6, 4e6, 3e6, 1e6], 1), (1702, [-4e6, 3e6, 3e6, 1e6], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("mine") for c in ("v", "r", "a", "n", "positives", "anchor_id")})
    assert rows_of(negatives.mine(df)) == slow_negatives(rows)
    assert negatives.mine(df.limit(0)).collect() == []


def test_negatives_of_vectors_whose_squares_pass_64_bits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=5) * 10.0 ** rng.integers(-1, 4)).tolist(), int(rng.integers(0, 3))) for i in range(240)]
    for i in range(0, 240, 9):  # one component of so much: squares pass 64 bits, products with most others do not
        rows[i][1][i % 5] = float((-1) ** i * 10 ** rng.integers(7, 13))
    whole = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows}
    assert any(sum(x * x for x in v) >= 2**63 for _, v in whole.values())
    long = lambda s: s if -(2**63) <= s < 2**63 else None
    want = []
    for a in range(0, 240, 60):
        label, v = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in whole.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fits = [(-t, i) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s]
            want += [(a, p, k + 1, i, long(-s), long(t)) for k, (t, i) in enumerate(fits[:10])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert len(want) > 20 and any(r[5] is not None and sum(x * x for x in whole[r[3]][1]) >= 2**63 for r in want)
    assert rows_of(negatives.mine(df, anchors=60)) == sorted(want, key=repr)
    assert rows_of(negatives.mine(df, anchors=60, row_block=30, anchor_block=2)) == sorted(want, key=repr)


def test_score_keys_keep_the_order_of_integers():
    values = sorted({sign * (1 << b) + d for sign in (-1, 1) for b in range(0, 136, 5) for d in (-1, 0, 1)})
    keys = [negatives.score_key(v) for v in values]
    assert keys == sorted(keys) and [negatives.key_score(k) for k in keys] == values


def test_negatives_sql_equals_the_operator(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(duckdb.sql(negatives.oracle()).fetchall(), key=repr) == rows_of(negatives.mine(spark.read.parquet(f"{SF}/embeddings.parquet")))


# ---------------------------------------------------------------- Jaccard join


def slow_sets(texts):
    words = [re.findall(rb"[^\x20\x09-\x0d]+", lowered(t)) for t in texts]
    return [{b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in words]


def slow_jaccard(rows):
    sets = slow_sets([t for _, t in rows])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in holders[x]).items():
            if 100 * shared >= 90 * (len(s) + len(sets[j]) - shared):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(count, words, edits, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 400, words)]
    out = []
    for _ in range(count):
        text = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            text[at] = f"v{rng.integers(0, 9)}"
        out.append(" ".join(text))
    return out


def test_jaccard_equals_brute_force(spark, documents, odd):
    for df in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert rows_of(jaccard.jaccard_components(df)) == slow_jaccard(rows)


@pytest.mark.parametrize("list_length, block", [(1000, 2048), (16, 2048), (1, 2048), (1, 30)])
def test_jaccard_of_large_groups(spark, monkeypatch, list_length, block):
    for name, value in {"LIST": list_length, "COMMON": 8, "LOCAL": 1, "BLOCK_DOCS": block}.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = near_copies(150, 60, 4, 1) + near_copies(60, 200, 12, 2) + near_copies(40, 25, 1, 3) + ["only two", "Only  TWO", "one", "ONE", "", None]
    texts += [" ".join(near_copies(1, 50, 0, 9) + [f"x{i}-{j}" for j in range(i % 7)]) for i in range(60)]
    rows = list(enumerate(texts)) + [(3, texts[0]), (None, texts[5]), (None, "far from all others")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(jaccard.jaccard_components(df)) == slow_jaccard(rows)


def test_jaccard_of_nothing(spark, empty):
    df = jaccard.jaccard_components(empty)
    assert df.collect() == [] and df.columns == ["doc_id", "n_shingles", "component_id"]


def test_prefixes_share_as_many_shingles_as_they_ask_for():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        base = rng.choice(10**6, n + 20, replace=False).astype(np.uint64)
        a, b = np.sort(base[:n]), np.sort(rng.permutation(base)[:n])
        common = (np.sort(base)[:: int(rng.integers(1, 4))], rng.integers(2, 3000, 200))
        common = (common[0], common[1][: len(common[0])])
        shared = len(np.intersect1d(a, b))
        assert jaccard.sketch_distance(jaccard.sketch(a), jaccard.sketch(b)) <= 2 * (n - shared)
        if jaccard.linked(shared, n, n, 90):
            (x, f), (y, g) = jaccard.ordered(a, common), jaccard.ordered(b, common)
            p, q = jaccard.matches(f, 90), jaccard.matches(g, 90)
            left, right = x[: n - jaccard.required(n, 90) + p], y[: n - jaccard.required(n, 90) + q]
            assert len(np.intersect1d(left, right)) >= min(p, q)


def test_common_shingles_ask_for_more_matches():
    assert jaccard.matches(np.zeros(100, np.int64), 90) == 1
    assert jaccard.matches(np.full(100, 5000), 90) > jaccard.matches(np.full(100, 200), 90) > 1


def test_hot_keys_join_like_any_other(spark):
    rows = spark.range(500).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    facts = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    for least in (1, 80, 10_000):
        assert rows_of(hotkeys.join_hot(rows, facts, ["k"], least=least)) == rows_of(rows.join(facts, "k"))


# ---------------------------------------------------------------- nearest neighbours and shards: odd rows


@pytest.mark.parametrize("size", [1e200, 1e-200, 1.0])
def test_nearest_of_doubles_of_any_size(spark, size):
    from trainset.llm import ann

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    df = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, leaf_rows=60, recall=1.0).collect()}
    for q in (0, 50):
        order = sorted(((-float(unit[q] @ unit[i]), i) for i in range(60) if i != q))[:5]
        assert [found[q, k + 1][0] for k in range(5)] == [i for _, i in order]
        assert all(abs(found[q, k + 1][1] + s) < 1e-12 for k, (s, _) in enumerate(order))


def test_shard_columns_of_any_case_give_way(spark):
    from trainset.llm import shards

    df = spark.createDataFrame([(1, "a", "mine", "mine")], "doc_id long, text string, Shard string, GROWN_SHARD string")
    assert shards.with_shard(df, grown=True).columns == ["doc_id", "text", "shard", "grown_shard"]
