"""Classifiers by held-out accuracy, nearest neighbours by recall, url rules and the pipeline; edge cases."""

import zlib

import numpy as np
import pytest
from helpers import SF, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from trainset.llm import ann, langid, quality, toxicity, urls

SMALL = "/root/testdata/sf0.01"


def tables(spark, *names):
    return [spark.read.parquet(f"{SMALL}/{n}.parquet") for n in names]


def held(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


@pytest.mark.parametrize("score, label, folds, fold, least", [(quality.score_quality, "quality", 4, 2, 0.93), (toxicity.score_toxicity, "toxic", 5, 0, 0.93)])
def test_classifiers_on_held_out_rows(spark, odd, empty, score, label, folds, fold, least):
    docs, labels = tables(spark, "documents", "labels")
    rows = score(docs, labels).collect()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held(r["doc_id"], folds, fold) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(judged) >= least
    more = labels.unionAll(labels.limit(5)).unionAll(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))
    assert score(odd, more).count() == odd.count()
    assert score(odd, labels.limit(0)).where("score IS NULL").count() == 0
    assert score(empty, labels).count() == 0


def test_labels_of_the_held_out_rows_change_nothing(spark):
    docs, labels = tables(spark, "documents", "labels")
    for score, label, folds, fold in ((quality.score_quality, "quality", 4, 2), (toxicity.score_toxicity, "toxic", 5, 0)):
        out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold
        flipped = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = ({r["doc_id"]: r["score"] for r in score(docs, x).collect()} for x in (labels, flipped))
        assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_isotonic_pools_falling_neighbours():
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1, 1, 3, 1])).tolist() == pytest.approx([0.1, 0.35, 0.35, 0.9])


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    y = rng.random(40000) < 0.1
    good, bad = np.array([0.7, 0.6, 0.5, 0.8, 0.65]), np.array([0.02, 0.05, 0.01, 0.1, 0.03])
    votes = (rng.random((len(y), 5)) < np.where(y[:, None], good, bad)).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # the last voter copies the first
    model = toxicity.fit_label_model(votes.T @ votes, len(y), 0.1)
    assert (0, 5) in model.correlated
    assert np.abs(model.fires[1][1:5] - good[1:5]).max() < 0.12 and np.abs(model.fires[0][1:5] - bad[1:5]).max() < 0.03
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.96


def test_keep_good_keeps_columns(spark, odd, empty):
    _, labels = tables(spark, "documents", "labels")
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    scores = {r["doc_id"] for r in quality.score_quality(odd, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == scores
    assert quality.keep_good(empty, labels).count() == 0


def test_language_codes(spark, odd, empty):
    (docs,) = tables(spark, "documents")
    rows = langid.identify(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd).collect() if r["doc_id"]}
    assert all(got[i] == ("und", 0.0) for i in (1001, 1002, 1003, 1004)) and got[1005][0] != "und"
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(empty).count() == 0


@pytest.mark.parametrize("n", [2, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    book = langid.code_book(n)
    apart = min((book[i] != book[j]).sum() for i in range(n) for j in range(i))
    assert apart >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else 4)
    assert all(set(column) == {-1, 1} for column in book.T)


def brute(rows, k, every):
    out = {}
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    size = np.linalg.norm(x, axis=1)
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i] / (size * size[i])
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_nearest_recall_and_scores(spark):
    (table,) = tables(spark, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = brute(rows, 5, 50)
    got = {}
    for r in ann.nearest(table, leaf_rows=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    assert all([r for r, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    assert np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]) >= 0.9
    exact = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(s - exact[q, v]) < 1e-12 for q in got for _, v, s in got[q] if (q, v) in exact)


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>, score string, leaf int"
    rows = [(i, [1.0, float(i % 3), 0.5], "x", 1) for i in range(0, 120)] + [
        (None, [1.0, 1.0, 1.0], "x", 1), (150, None, "x", 1), (200, [0.0, 0.0, 0.0], "x", 1), (250, [1.0, None, 1.0], "x", 1),
        (300, [1.0, float("nan"), 1.0], "x", 1), (350, [float("inf"), 1.0, 1.0], "x", 1), (400, [], "x", 1), (450, [1.0, 2.0], "x", 1), (50, [1.0, 2.0, 0.5], "x", 1),
    ]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, schema)).collect())
    want = brute([r for r in rows if r[0] is not None and r[0] < 120][:120], 5, 50)
    assert [(q, r, v) for q, r, v, _ in got] == [(q, i + 1, v) for q in (0, 50, 100) for i, (v, _) in enumerate(want[q])]
    two = spark.createDataFrame(rows[:1] + rows[50:51], schema)
    assert [(q, r, v) for q, r, v, _ in rows_of(ann.nearest(two))] == [(0, 1, 50), (50, 1, 0)]
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0


def test_url_edges(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/net/": ("", "", None, "allow"),
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
        "http://net": ("net", "", None, "allow"), "http://net/": ("net", "/", "net/", "block"), "http://xnet/": ("xnet", "/", None, "allow"),
        "s://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"), "s://my-example.com/de/1": ("my-example.com", "/de/1", None, "allow"),
        "s://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"), "s://casino-x.org/fr/": ("casino-x.org", "/fr/", "org/fr/", "allow"),
        "s://casino-x.org/en/": ("casino-x.org", "/en/", None, "block"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "s://x.io/y/login": ("x.io", "/y/login", None, "block"),
        "s://example.net:80/en/": ("example.net:80", "/en/", None, "allow"), "s://#/x": ("", "", None, "allow"),
    }
    rows = [(i, u, "rule") for i, u in enumerate(cases)] * 2 + [(None, "http://net/", "r")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"))
    want = [(i, *c) for i, c in enumerate(cases.values())] * 2 + [(None, "net", "/", "net/", "block")]
    assert rows_of(got) == sorted(want, key=repr)
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rule = urls.host_rule("block", "example.com/de/ar")
    assert rule.tokens == ("com", "de", "example")
    assert list(urls.rule_index((rule,), {"com": 9, "de": 2, "example": 5})) == ["de"]


def test_pipeline_stages_keep_columns_and_rows_agree(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == odd.columns
        assert out.count() <= docs.count()
        docs = out
    ran = corpus_pipeline.run(spark, SF)
    assert "shard" in ran.columns and ran.select("doc_id").distinct().count() == ran.count()
