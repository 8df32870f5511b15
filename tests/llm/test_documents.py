"""Fingerprints, contamination, tokens, shards and mixing against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import SF, rows_of
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trainset.llm import decontaminate, mixing, shards, simhash, token_counts


# ---------------------------------------------------------------- SimHash


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_roots(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def slow_components(rows):
    prints = {i: slow_fingerprint(t) for i, (_, t) in enumerate(rows)}
    roots = slow_roots(set(prints.values()))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = roots[prints[i]]
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(((d, f"{prints[i]:016x}", least.get(roots[prints[i]])) for i, (d, _) in enumerate(rows)), key=repr)


def test_simhash_equals_brute_force(spark, documents, odd):
    for df in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert rows_of(simhash.near_duplicates(df)) == slow_components(rows)


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(list(range(64)))
    rng = random.Random(3)
    for _ in range(3000):
        differing = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & differing == 0 for m in masks)
    free = simhash._free(masks[0])
    finer = simhash.covering_masks(free)
    for bits in itertools.islice(itertools.combinations(free, 4), 3000):
        assert any(m & sum(1 << b for b in bits) == 0 for m in finer)


def test_large_buckets_are_dealt_anew(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 300:
        prints.add(rng.choice(sorted(prints)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))))
    signed = [simhash._signed(p) for p in prints]
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.find_links(distinct, bucket=8)
    for row in links.collect():
        assert ((row["a"] ^ row["b"]) % (1 << 64)).bit_count() <= 4
    got = dict(tuple(r) for r in simhash.components(links).collect())
    want = slow_roots({p % (1 << 64) for p in signed})
    same = {}
    for p in signed:
        same.setdefault(got.get(p, p), set()).add(want[p % (1 << 64)])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want.values()))


def test_sharding_stage_tells_the_grown_shard(spark, documents):
    import corpus_pipeline

    got = rows_of(corpus_pipeline.shard(spark, documents, None).select("doc_id", "shard", "grown_shard"))
    assert got == rows_of(shards.shard_slots(documents).select("doc_id", "shard", "grown_shard"))
    assert {b for _, a, b in got if a != b} == {8}


def test_full_buckets_of_few_free_bits_end(spark):
    """All patterns of 12 of the bits that a second-level mask leaves free: one component, over BUCKET fingerprints."""
    first = simhash.covering_masks(list(range(64)))[0]
    second = first | simhash.covering_masks(simhash._free(first))[-1]
    bits = simhash._free(second)[:12]
    assert len(bits) == 12 and 2 ** len(bits) > simhash.BUCKET
    base = random.Random(7).getrandbits(64) & second
    prints = [simhash._signed(base | sum(1 << b for i, b in enumerate(bits) if n >> i & 1)) for n in range(2 ** len(bits))]
    links = simhash.find_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {tuple(r) for r in simhash.components(links).collect()}
    assert got == {(p, min(prints)) for p in prints if p != min(prints)}


def test_finer_masks_keep_more_bits():
    for radius in (1, 4, 5, 7):
        for n in range(max(simhash.FREE, radius + 1) + 1, 65):
            assert all(simhash.covering_masks(list(range(n)), radius))


def test_keep_one_per_group(spark, odd, empty):
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    groups = slow_components([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter({g[2]: 1 for g in groups})
    assert simhash.keep_one_per_group(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


# ---------------------------------------------------------------- contamination


def slow_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_contamination(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, found = slow_words(text), set(), set()
        for item, item_text in items:
            w = slow_words(item_text)
            size = min(13, len(w))
            windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(words) - size + 1) if w else ():
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    return rows + [(900, "one"), (901, "of the"), (902, None), (903, "%% !"), (None, "two of the"), (rows[0]), (904, "the of the of the")]


@pytest.mark.parametrize("block_words", [200_000, 700])
def test_contamination_equals_brute_force(spark, documents, odd, items, block_words):
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    near = [(5000 + i, f"x {t} y {t[len(t) // 2:]}", "en", "s", 1) for i, (_, t) in enumerate(items[:20])]
    docs = documents.unionAll(odd.select(*documents.columns)).unionAll(spark.createDataFrame(near, documents.schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = decontaminate.find_contamination(docs, benchmark, block_words=block_words).drop("items", "spans")
    assert rows_of(got) == slow_contamination(rows, items)


def test_automaton_on_small_alphabet():
    rng = random.Random(1)
    for _ in range(60):
        items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))]) for i in range(6)]
        doc = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(80)]
        spans, found = decontaminate.Automaton(items, 5).search(doc)
        hit, want = set(), set()
        for item, w in items:
            size = min(5, len(w))
            for i in range(len(doc) - size + 1):
                if any(doc[i : i + size] == w[j : j + size] for j in range(len(w) - size + 1)):
                    hit |= set(range(i, i + size))
                    want.add(item)
        assert found == want and {x for a, b in spans for x in range(a, b)} == hit


def test_drop_and_cut(spark, odd, empty, items):
    benchmark = spark.createDataFrame(items[:40], "item_id long, text string")
    passage = items[0][1]
    more = odd.where("doc_id = 1006").limit(1)
    bad = more.withColumn("text", F.lit(passage)).withColumn("doc_id", F.lit(7).cast("long"))
    partly = more.withColumn("text", F.concat(F.lit("start " * 60), F.lit(passage), F.lit(" end" * 60))).withColumn("doc_id", F.lit(8).cast("long"))
    docs = odd.where("doc_id > 1000 OR doc_id IS NULL").unionByName(bad).unionByName(partly)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.where("doc_id IN (7, 8)").count() == 0
    cut = decontaminate.cut_spans(docs, benchmark)
    assert cut.columns == docs.columns
    text = cut.where("doc_id = 8").first()["text"]
    assert passage.split()[3] not in text and text.startswith("start") and text.endswith("end")
    assert cut.where("doc_id = 7").count() == 0
    assert decontaminate.drop_contaminated(empty, benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where("contaminated").count() == 0


@pytest.mark.parametrize("block_words", [10**6, 60])
def test_no_long_span_is_left(spark, odd, empty, block_words):
    rng = random.Random(3)
    items = [(i % 3, " ".join(f"b{i}x{j}" for j in range(20))) for i in range(6)]
    items += [items[0]] * 300  # a hot item
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    one, two = items[0][1].split(), items[1][1].split()
    nested = " ".join([*one[:10], *two[2:18], *one[10:]])  # taking one span out makes another
    texts = [f"{filler(400)} {nested}! {filler(400)}", f"{filler(300)} {items[2][1]} {filler(300)}", f"{items[3][1]} {filler(9)}", filler(50), f"{filler(400)} {' '.join(one[:12])}."]
    more = odd.where("doc_id > 1000 OR doc_id IS NULL").limit(3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = more.select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars")).unionAll(docs)
    clean = decontaminate.remove_contamination(docs, benchmark, n_chars="n_chars", block_words=block_words)
    assert clean.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in clean.where("doc_id BETWEEN 0 AND 4").collect()}
    assert sorted(got) == [0, 1, 3, 4] and got[3][0] == texts[3] and got[4][0] == texts[4]
    assert len(got[0][0].split()) == 801 and "b0x" not in got[0][0] and len(got[1][0].split()) == 600
    assert all(n == len(t) for t, n in got.values())
    left = decontaminate.find_contamination(clean, benchmark).select("spans").collect()
    assert all(end - first < 13 for r in left for first, end in zip(r.spans[::2], r.spans[1::2]))
    assert clean.count() == docs.count() - 1
    assert decontaminate.remove_contamination(empty, benchmark).count() == 0


# ---------------------------------------------------------------- tokens


def library_counts(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.tokenizer_file())
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark, documents, odd, empty):
    docs = documents.unionAll(odd.select(*documents.columns))
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(rows, library_counts([r["text"] for r in rows]))), key=repr)
    assert rows_of(token_counts.count_tokens(docs)) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_every_prefix_equals_the_library():
    counter = token_counts.counter(token_counts.DEFAULT)
    rng = random.Random(2)
    letters = "ab'sltrevdm AÉé1½.,!?;:́ \x1f　<|endoftext>Σßİ你가"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    texts += ["it's they'll we've", "a<|endoftext|>b <|startoftext|>", "", " "]
    for text in texts:
        assert counter.prefixes(text) == library_counts([text[:i] for i in range(len(text) + 1)]), text


def test_stored_counts_answer_budgets(spark, odd, empty):
    stored = token_counts.store_prefix_counts(odd.where("doc_id < 5 OR doc_id > 1000"))
    asked = stored.select("doc_id", F.size("counts").alias("n"), token_counts.tokens_at(F.col("counts"), 7).alias("at"), token_counts.prefix_within(F.col("counts"), 20).alias("fits"))
    texts = {r["doc_id"]: r["text"] or "" for r in odd.select("doc_id", "text").collect()}
    for r in asked.collect():
        text = texts[r["doc_id"]]
        assert r["n"] == len(text) + 1
        assert r["at"] == library_counts([text[:7]])[0]
        assert library_counts([text[: r["fits"]]])[0] <= 20
    assert token_counts.store_prefix_counts(empty).count() == 0


# ---------------------------------------------------------------- shards


def test_shards(spark, odd, empty):
    rows = shards.shard_slots(odd).collect()
    assert len(rows) == odd.count()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in odd.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shards.shard_slots(empty).count() == 0
    assert shards.with_shard(odd).columns == [c for c in odd.columns if c != "shard"] + ["shard"]


def test_weights_and_confined_moves(spark):
    keys = spark.range(20000)
    tree = shards.default_tree(8)
    heavy = tuple(shards.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 2 else 1.0) for x in tree)
    fixed = {("r0",): 4.0, ("r1",): 4.0, ("r0", "k0"): 2.0, ("r0", "k1"): 2.0}
    df = keys.select(
        shards.shard_of(F.col("id"), tree).alias("old"),
        shards.shard_of(F.col("id"), heavy).alias("grown"),
        shards.shard_of(F.col("id"), heavy, fixed).alias("inside"),
        shards.shard_of(F.col("id"), shards.default_tree(9)).alias("nine"),
    ).toPandas()
    assert abs(np.bincount(df.old) / 20000 - 1 / 8).max() < 0.01
    assert abs(np.bincount(df.nine) / 20000 - 1 / 9).max() < 0.01
    assert abs(np.bincount(df.grown)[2] / 20000 - 0.3) < 0.02
    moved = df[df.old != df.inside]
    assert len(moved) and set(moved.old) == {3} and set(moved.inside) == {2}
    assert set(df[df.old != df.nine].nine) == {8}
    with pytest.raises(ValueError):
        shards.shard_of(F.col("id"), (shards.Leaf("a", "b", 0, 0.0),))


# ---------------------------------------------------------------- mixing


def test_mixing_equals_sql_on_odd_rows(spark, odd, empty):
    con = duckdb.connect()
    con.register("documents", odd.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    for fraction, epochs in ((0.6, 3), (0.3, 1), (2.5, 2)):
        want = sorted(con.execute(mixing.oracle(fraction=fraction, max_epochs=epochs)).fetchall(), key=repr)
        assert rows_of(mixing.mix_plan_and_rows(odd, budget_fraction=fraction, max_epochs=epochs)) == want
    kept = mixing.mix_documents(odd, budget_fraction=0.6, max_epochs=3)
    assert kept.columns == odd.columns and kept.count() == mixing.mix_plan_and_rows(odd).count()
    assert mixing.mix_documents(empty).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    tree = mixing.Tree(F.substring("source", 1, 1), F.lit(1.0), F.lit(1.0), F.lit(1.0))
    leaves = spark.createDataFrame([("a", "x", "a1", 10), ("a", "x", "a2", 500), ("b", "x", "b1", 500)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, tree, 1.0, 400, 1).collect()}
    assert got == {"a1": 10, "a2": 190, "b1": 200}
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves.where("source <> 'a2'"), tree, 1.0, 400, 1).collect()}
    assert got == {"a1": 10, "b1": 390}
