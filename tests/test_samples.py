"""Samples of mixed, repeated records for each objective, and the report on them."""

import re
from zlib import crc32

import pytest

from trainset.operators import render
from trainset.plans.samples import build_report, build_samples
from trainset.schema import MESSAGE

END = "<|endoftext|>"
SHOWN = "<|im_start|>user\nq one<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\ntwo three<|im_end|>\n"
FIELDS = f"array<{MESSAGE.simpleString()}>"
SCHEMA = f"seq long, kind string, messages {FIELDS}, text string, prompt string, completion string, repeat int, chosen {FIELDS}, rejected {FIELDS}"


def ids(text):
    return [crc32(t.encode()) & 0x7FFFFFFF for t in re.findall(r"[A-Za-z]+|[0-9]+|[ \t]+|(?s:.)", text)]


def say(role, text):
    return tuple({"role": role, "content": text}.get(f.name) for f in MESSAGE.fields)


@pytest.fixture(scope="module")
def mixed(spark):
    ask, long = say("user", "q one"), "w " * 300
    rows = [
        (1, "trace", [ask, say("assistant", "two three")], None, None, None, 3, None, None),
        (2, "text", None, "one two " * 40, None, None, 2, None, None),
        (3, "completion", None, None, "a b", " c", 2, None, None),
        (4, "completion", None, None, long, "d", None, None, None),
        (5, "image", None, None, None, None, 2, None, None),
        (6, "trace", [ask], None, None, None, 3, [say("assistant", "two three")], [say("assistant", "no")]),
        (7, "trace", [ask], None, None, None, 2, [say("assistant", "two three")], [say("assistant", long)]),
        (8, "trace", [ask], None, None, None, 1, [say("assistant", "two three")], []),
        (9, "trace", [say("user", " ")], None, None, None, 1, [say("assistant", "x")], [say("assistant", "y")]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def loader():
    """A tokenizer that knows the markers; nested, so that it travels by value."""

    def load():
        import re
        from zlib import crc32

        def encode(texts):
            found = [list(re.finditer(r"<\|\w+\|>|\w+|\W", t)) for t in texts]
            return [([crc32(m[0].encode()) & 0x7FFFFFFF for m in ms], [m.start() for m in ms], [m.end() for m in ms]) for ms in found]

        return encode

    return load


def test_sft_takes_every_kind_and_repeat(mixed):
    made = {}
    for r in build_samples(mixed, render.CHATML, "sft", 100).collect():
        assert (r["seq"], r["copy"], r["start"]) not in made
        made[r["seq"], r["copy"], r["start"]] = (r["input_ids"], r["labels"])
    whole = ids("one two " * 40) + [crc32(END.encode()) & 0x7FFFFFFF]
    want = {(1, c, 0) for c in (1, 2, 3)} | {(2, c, s) for c in (1, 2) for s in (0, 100)} | {(3, 1, 0), (3, 2, 0)}
    want |= {(6, c, 0) for c in (1, 2, 3)} | {(7, 1, 0), (7, 2, 0), (8, 1, 0)}
    assert set(made) == want
    assert made[1, 3, 0][0] == ids(SHOWN)
    assert made[2, 1, 0][0] + made[2, 2, 100][0] == whole and made[2, 1, 0][0] == made[2, 1, 0][1]
    answer = ids(" c") + whole[-1:]
    assert made[3, 2, 0] == (ids("a b") + answer, [-100] * 3 + answer)


def test_cpt_takes_every_kind_and_repeat(mixed):
    """The stream is the documents in some order, each ended by its marker."""
    blocks = build_samples(mixed.where("seq < 6"), render.CHATML, "cpt", 64).orderBy("block").collect()
    stream = [t for b in blocks for t in b["input_ids"]]
    end, docs = crc32(END.encode()) & 0x7FFFFFFF, [[]]
    for t in stream:
        docs.append([]) if t == end else docs[-1].append(t)
    want = [ids(SHOWN)] * 3 + [ids("one two " * 40)] * 2 + [ids("a b c")] * 2 + [ids("w " * 300 + "d")]
    assert docs.pop() == [] and sorted(docs) == sorted(want)


def test_dpo_repeats_pairs(mixed):
    made = build_samples(mixed, render.CHATML, "dpo", 100).collect()
    assert sorted((r["seq"], r["copy"]) for r in made) == [(6, 1), (6, 2), (6, 3)]
    cut = build_samples(mixed, render.CHATML, "dpo", 100, "truncate").collect()
    assert sorted((r["seq"], r["copy"]) for r in cut) == [(6, 1), (6, 2), (6, 3), (7, 1), (7, 2)]
    assert {len(r["rejected_ids"]) for r in cut if r["seq"] == 7} == {100}


def test_report_counts_every_record(mixed):
    def told(objective, **how):
        return {tuple(r)[:2]: r["n"] for r in build_report(mixed, render.CHATML, 100, objective=objective, **how).collect()}

    image, blank = ("unrenderable", "image records make no samples of tokens"), ("unrenderable", "user turn without text")
    assert told("sft") == {("sample", None): 3 + 2 + 2 + 3 + 2 + 1, ("skipped_long", None): 1, image: 2, blank: 1}
    assert told("sft", overflow="truncate") == {("sample", None): 13, ("skipped_untrainable", None): 1, image: 2, blank: 1}
    assert told("cpt") == {("sample", None): 14, image: 2, blank: 1}
    assert told("dpo") == {("sample", None): 3, ("skipped_long", None): 2, ("not_preference", None): 3 + 2 + 2 + 1 + 2 + 1, blank: 1}


def test_any_tokenizer_takes_every_kind(mixed):
    load, end = loader(), crc32(END.encode()) & 0x7FFFFFFF
    words = load()
    made = {(r["seq"], r["copy"], r["start"]): r["labels"] for r in build_samples(mixed, render.CHATML, "sft", 100, tokenizer=load).collect()}
    assert made[3, 2, 0] == [-100] * 3 + words([" c"])[0][0] + [end]
    assert made[2, 2, 0] + made[2, 2, 100] == words(["one two " * 40 + END])[0][0]
    blocks = build_samples(mixed.where("seq < 6"), render.CHATML, "cpt", 64, tokenizer=load).collect()
    texts = [SHOWN] * 3 + ["one two " * 40] * 2 + ["a b c"] * 2 + ["w " * 300 + "d"]
    assert sorted(t for b in blocks for t in b["input_ids"]) == sorted(t for x in texts for t in words([x + END])[0][0])


THOUGHT = "<think>\nr{0}\n</think>\n\n"


def turn(role, text):
    body = text if role != "assistant" else text
    return f"<|im_start|>{role}\n{body}<|im_end|>\n"


def reasoned(spark, rows):
    return spark.createDataFrame(rows, f"seq long, kind string, messages {FIELDS}, repeat int, train_on string")


def think(text, reasoning, train=None):
    return tuple({"role": "assistant", "content": text, "reasoning": reasoning, "train": train}.get(f.name) for f in MESSAGE.fields)


def test_each_reasoned_answer_is_a_sample(spark):
    """History without earlier reasoning, but with that of the same turn; nothing but the answer is learned."""
    talk = [say("user", "q1"), think("a1", "r1"), say("user", "q2"), think("a2", "r2"), think("a3", "r3"), think("a4", "r4", False), say("user", "q3"), think("a5", None)]
    rows = [(1, "trace", talk, 2, None), (2, "trace", talk, 1, "all"), (3, "trace", talk[2:4], 1, None), (4, "trace", talk, 1, "last")]
    made = build_samples(reasoned(spark, rows), render.CHATML, "sft", 400).collect()
    got = {(r["seq"], r["copy"], r["answer_turn"]): (r["input_ids"], [t for t in r["labels"] if t != -100]) for r in made}
    assert set(got) == {(1, c, a) for c in (1, 2) for a in (1, 3, 4, 7)} | {(2, 1, None), (3, 1, None)} | {(4, 1, a) for a in (1, 3, 4, 7)}
    t1, t2, t3 = (THOUGHT.format(i) for i in (1, 2, 3))
    history = turn("user", "q1") + turn("assistant", "a1") + turn("user", "q2")
    assert got[1, 2, 1] == (ids(turn("user", "q1") + turn("assistant", t1 + "a1")), ids(t1 + "a1<|im_end|>"))
    assert got[1, 1, 4] == (ids(history + turn("assistant", t2 + "a2") + turn("assistant", t3 + "a3")), ids(t3 + "a3<|im_end|>"))
    empty = "<think>\n\n</think>\n\n"
    whole = history + turn("assistant", "a2") + turn("assistant", "a3") + turn("assistant", "a4") + turn("user", "q3") + turn("assistant", empty + "a5")
    assert got[1, 1, 7] == got[4, 1, 7] == (ids(whole), ids("a5<|im_end|>"))
    assert {(r["seq"], r["answer_turn"]) for r in build_samples(reasoned(spark, rows[:1]), render.CHATML, "sft", 400, expand=False).collect()} == {(1, None)}


def test_samples_of_answers_end_where_they_no_longer_fit(spark):
    talk = [m for i in range(300) for m in (say("user", f"q {i}"), think(f"a {i}", f"r {i}"))]
    df = reasoned(spark, [(1, "trace", talk, 1, None)])
    for load in (None, loader()):
        made = build_samples(df, render.CHATML, "sft", 200, tokenizer=load).collect()
        turns = sorted(r["answer_turn"] for r in made)
        assert turns == list(range(1, 2 * len(turns), 2)) and 3 < len(turns) < 30 and max(len(r["input_ids"]) for r in made) <= 200


def test_images_alone_make_no_samples(spark):
    df = spark.createDataFrame([(1, "image")], "seq long, kind string")
    for objective in ("sft", "cpt", "dpo"):
        assert build_samples(df, render.CHATML, objective, 50).collect() == []


def test_token_report(spark, mixed):
    from trainset.plans.samples import token_report

    records = mixed.where("seq IN (1, 2, 3, 4, 5, 9)").drop("chosen", "rejected")
    got = {(r["part"], r["name"]): r["value"] for r in token_report(records, render.CHATML, 200, candidates=(200, 512)).collect()}
    shown, text = len(ids(SHOWN)), len(ids("one two " * 40)) + 1
    sizes = sorted([shown] * 3 + [text] * 2 + [len(ids("a b c")) + 1] * 2 + [len(ids("w " * 300)) + 2])
    assert got["tokens", "samples"] == 8 and got["tokens", "total"] == sum(sizes) and got["tokens", "max"] == sizes[-1] and got["tokens", "min"] == sizes[0]
    assert got["tokens", "over_max_len"] == 1 and got["coverage", "200"] == 0.875 and got["coverage", "512"] == 0.875
    learned = [len(ids("two three<|im_end|>"))] * 3 + [text] * 2 + [len(ids(" c")) + 1] * 2 + [2]
    assert got["tokens", "trainable_mean"] == round(sum(learned) / 8)
    assert got["failure", "user turn without text"] == 1
    none = {r["name"]: r["value"] for r in token_report(records.limit(0), render.CHATML).collect()}
    assert none["samples"] == 0 and "p50" not in none
    images = records.where("seq = 5").select("seq", "kind", "repeat")
    assert {r["name"]: r["value"] for r in token_report(images, render.CHATML).collect()}["samples"] == 0


def test_token_report_counts_each_reasoned_answer(spark):
    from trainset.plans.samples import token_report

    think = lambda text, thought: tuple({"role": "assistant", "content": text, "reasoning": thought}.get(f.name) for f in MESSAGE.fields)
    talk = [say("user", "q one"), think("a b", "so"), say("user", "and then"), think("c", "well"), say("user", "end"), think("d e", "done")]
    records = spark.createDataFrame([(1, "trace", talk, 2)], f"seq long, kind string, messages {FIELDS}, repeat int")
    made = [(len(r["input_ids"]), sum(x != -100 for x in r["labels"])) for r in build_samples(records, render.CHATML, "sft", 10**6).collect()]
    got = {r["name"]: r["value"] for r in token_report(records, render.CHATML).collect()}
    assert len(made) == 6 and got["samples"] == 6 and got["total"] == sum(n for n, _ in made)
    assert got["trainable_mean"] == round(sum(m for _, m in made) / 6)
