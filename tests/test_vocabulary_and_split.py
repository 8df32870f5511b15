"""Dense vocabularies against a count in Python, split JSON arrays against the json module."""

import json
import random
from collections import Counter
from functools import partial
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from trainset.operators import vocabulary as vocabulary_module
from trainset.operators.vocabulary import build_vocabulary, encode_with_vocabulary
from trainset.sources import files
from trainset.sources.split import json_pieces


def expected_ids(texts, min_count, specials):
    counts = Counter(w for t in texts if t for w in t.split(" "))
    ranked = sorted((w for w, n in counts.items() if n >= min_count and w not in specials), key=lambda w: (-counts[w], md5(w.encode()).hexdigest(), w))
    return {w: i for i, w in enumerate([*specials, *ranked])}


@pytest.mark.parametrize("min_count,specials", [(1, ("<unk>",)), (2, ("<unk>", "hot")), (1, ())])
def test_vocabulary_is_dense_and_codes_every_text(spark, min_count, specials):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["hot", "ä", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    texts += [None, "hot", " ".join(["hot"] * 500), "once"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    words = F.split("body", " ")
    vocabulary = build_vocabulary(df, "body", min_count, specials, tokens=words)
    want = expected_ids(texts, min_count, specials)
    assert {r.token: r.id for r in vocabulary.collect()} == want
    assert sorted(want.values()) == list(range(len(want)))
    for hot in (0, 3, 10**6):
        coded = encode_with_vocabulary(df, vocabulary, "k", "body", block_tokens=64, hot=hot, tokens=words)
        rows = sorted((r.k, r.block, r.ids) for r in coded.collect())
        assert all(len(ids) <= 64 for _, _, ids in rows)
        got = {k: [i for kk, _, ids in rows if kk == k for i in ids] for k, _, _ in rows}
        assert got == {k: [want.get(w, 0) for w in t.split(" ")] if t else [] for k, t in enumerate(texts)}


def test_vocabulary_of_nothing(spark):
    df = spark.createDataFrame([], "k long, text string")
    vocabulary = build_vocabulary(df)
    assert [tuple(r) for r in vocabulary.collect()] == [("<unk>", 0, 0)]
    assert encode_with_vocabulary(df, vocabulary, "k").count() == 0
    with pytest.raises(ValueError):
        encode_with_vocabulary(df, vocabulary, "k", block_tokens=10**6)


def shuffled_rows(plan):
    """Rows written by the exchanges of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled_rows(plan.plan())
    metrics, children = plan.metrics(), plan.children()
    own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
    return own + sum(shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_coding_moves_distinct_tokens(spark):
    """A token met in many places goes through the join on tokens once a group, not once an occurrence."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(500)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string").coalesce(1)
    words = F.split("body", " ")
    vocabulary = spark.createDataFrame([(w, n) for n, w in enumerate(["<unk>", *(f"w{i}" for i in range(39))])], "token string, id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = encode_with_vocabulary(df, vocabulary, "k", "body", hot=0, tokens=words)
        rows = coded.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {f"w{i}": i + 1 for i in range(39)}
    assert {(r.k, r.block): r.ids for r in rows} == {(k, 0): [want.get(w, 0) for w in t.split(" ")] for k, t in enumerate(texts)}
    assert shuffled_rows(coded._jdf.queryExecution().executedPlan()) < 1000  # of 20,000 tokens


def test_coding_in_many_groups_with_null_tokens_and_shared_keys(spark, monkeypatch):
    monkeypatch.setattr(vocabulary_module, "_grouped", partial(vocabulary_module._grouped, most=50))
    df = spark.createDataFrame([(1, ["a", None, "b"]), (1, ["c", "a"]), (2, []), (None, ["b"] * 70), (None, ["z"])], "k long, w array<string>")
    vocabulary = spark.createDataFrame([("<unk>", 0), ("a", 1), ("b", 2), ("c", 3)], "token string, id long")
    for hot in (0, 2, 9):
        coded = encode_with_vocabulary(df, vocabulary, "k", block_tokens=30, hot=hot, tokens=F.col("w"))
        got = {(r.k, r.block): r.ids for r in coded.collect()}
        assert got == {(1, 0): [1, 3, 0, 1, 2], (2, 0): [], (None, 0): [0] + [2] * 30, (None, 1): [2] * 30, (None, 2): [2] * 10}


def odd_value(rng, depth=0):
    strings = ['}{"', '\\', 'a\\"}', "]},{[", "", "ä \n", '\\\\"']
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(strings)
    if kind < 4:
        return rng.choice([None, True, 7])
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(strings) + str(i): odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("indent", [None, 1])
def test_split_arrays_equal_whole_ones(spark, tmp_path, indent):
    rng = random.Random(11)
    values = [odd_value(rng) for _ in range(3000)] + [{"last": "}"}, 5, [{"x": 1}], "}"]
    path = tmp_path / "big.json"
    path.write_text(" \n" + json.dumps(values, indent=indent) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // 40))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert json_pieces(spark, str(path)).select("block").distinct().count() > 10
        rows = files.read_json_array(spark, str(path)).orderBy("record", "pos").select(F.to_json("raw").alias("j")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [json.loads(r.j) for r in rows] == [v for v in values if isinstance(v, dict)]


@pytest.mark.parametrize("text,n", [("[]", 0), ("[{}]", 1), (' [1, "}"]', 0), ('[{"a": {"b": []}},\n{"a": 2}]', 2), ('{"rows": [{"a": 1}, {"a": 2}]}', 2), ("", 0), ("\ufeff[{}, {}]", 2)])
def test_small_and_odd_documents(spark, tmp_path, text, n):
    (tmp_path / "d.json").write_text(text, encoding="utf-8")
    assert files.read_source(spark, str(tmp_path / "d.json")).count() == n
