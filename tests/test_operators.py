import random
import zlib

import pytest
from pyspark.sql import functions as F

from trainset.functions import text as X
from trainset.functions.tokens import token_count, token_ids, token_strings
from trainset.operators import clean, encode, sampling, stats
from trainset.operators.convert import convert_table
from trainset.operators.mapping import Mapping, detect_mapping
from trainset.operators.ordered import scan_groups, with_seq_position
from trainset.operators.render import CHATML, HEADER_ID, TURN_TAG, exclude_regions, render_error, render_turns
from trainset.operators.runs import ema, stage_chain, stage_roots
from trainset.operators.traces import assemble_traces, explode_turns, turn_fingerprints
from trainset.plans.imports import import_table
from trainset.plans.training_set import build_training_set


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_strip_matches_python(spark):
    for s in ["　 a b \x1c\n", "\xa0", "", " x ", "​keep​"]:
        assert one(spark, X.strip(F.col("s")), s=s) == s.strip()


def test_split_reasoning(spark):
    def split(s):
        return tuple(one(spark, X.split_reasoning(F.col("s")), s=s))

    assert split(" <think>\nr\n</think>\n\nans") == ("r", "ans")
    assert split("r</think>\nans") == ("r", "ans")
    assert split("</think>ans") == (None, "</think>ans")
    assert split("a</think>b</think>c") == (None, "a</think>b</think>c")
    assert split("x <think>y</think>") == (None, "x <think>y</think>")


def test_parse_reply(spark):
    def parse(s):
        return one(spark, F.to_json(X.parse_reply(F.col("s"))), s=s)

    assert parse('{"a":1}') == '{"a":1}'
    assert parse('ok\n```json\n{"a":1}\n```') == '{"a":1}'
    assert parse('say [1,2] now') == "[1,2]"
    assert parse("nothing") is None


def test_templates_fail_early(spark):
    with pytest.raises(KeyError):
        X.render_template("{nope}", ["a"])
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(X.render_template("{{{a}}}-{b}", df.columns)).first()[0] == "{x}-"


def test_tokens_cover_the_text(spark):
    s = "Héllo, wörld 42\t\tx\n\n<|im_start|>user\n¿qué? 数据"
    assert "".join(one(spark, token_strings(F.col("s")), s=s)) == s
    ids = one(spark, token_ids(F.col("s")), s="ab 1")
    assert ids == [zlib.crc32(t.encode()) & 0x7FFFFFFF for t in ("ab", " ", "1")]
    assert one(spark, token_count(F.col("s")), s=s) == len(one(spark, token_strings(F.col("s")), s=s))


def test_percentiles_match_the_definition(spark):
    rng = random.Random(1)
    values = [rng.choice([5, rng.randrange(200000)]) for _ in range(777)]
    row = stats.rank_percentiles(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    values.sort()
    for name, p in stats.RANKS.items():
        assert row[name] == values[min(len(values) - 1, max(0, round(p * (len(values) - 1))))]
    assert row["n"] == 777 and row["total"] == sum(values)


@pytest.mark.parametrize("partitions", ["1", "4", "200"])
def test_scan_groups_with_a_dominating_group(spark, partitions):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 20), i, rng.choice("abc") if rng.random() < 0.7 else None) for i in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = scan_groups(
            spark.createDataFrame(rows, "g int, o long, x string"), ["g"], "o", block_size=7, position="pos",
            previous={"p": F.col("x")}, latest={"l": F.col("x")}, following={"f": F.col("x")}, totals={"m": ("max", F.col("o"))},
        )
        got = {(r.g, r.o): (r.pos, r.p, r.l, r.f, r.m) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == g]
        for i, (_g, o, x) in enumerate(group):
            prev = next((r[2] for r in reversed(group[:i]) if r[2]), None)
            nxt = next((r[2] for r in group[i + 1 :] if r[2]), None)
            assert got[(g, o)] == (i, prev, x or prev, nxt, group[-1][1])


def test_positions(spark):
    seqs = random.Random(3).sample(range(10**9), 300) + [2**40]
    got = {r.seq: r.pos for r in with_seq_position(spark.createDataFrame([(s,) for s in seqs], "seq long"), "seq", "pos").collect()}
    assert got == {s: i for i, s in enumerate(sorted(seqs))}


def test_dedupe_first_wins_and_is_idempotent(spark):
    df = spark.createDataFrame([(i, f"k{i % 3 if i > 2 else 0}") for i in range(50)], "seq long, fp string")
    once = clean.dedupe_exact(df)
    assert sorted((r.fp, r.seq) for r in once.collect()) == [("k0", 0), ("k1", 4), ("k2", 5)]
    assert clean.dedupe_exact(once).count() == 3


def test_clean_reports_and_guards(spark):
    rows = [(i, f"q{i}\nanswer {i}", f"answer {i}", f"f{i}") for i in range(6)] + [(6, "q0\nanswer 0", "answer 0", "f0"), (7, "spam", "spam", "s")]
    df = spark.createDataFrame(rows, "seq long, everything string, a string, fp string").select(
        "*", F.length("everything").alias("all_chars"), F.length("a").alias("answer_chars"), F.lit(False).alias("empty")
    )
    marked = clean.clean(df, drop_matching="spam")
    assert {r.reason: r.n for r in clean.reject_report(marked).collect()} == {"kept": 6, "duplicate": 1, "matched_pattern": 1}
    again = clean.clean(clean.kept(marked), drop_matching="spam")
    assert clean.guard_not_empty(again) is False
    with pytest.raises(ValueError, match="no record would be left"):
        clean.guard_not_empty(clean.clean(df, min_answer_chars=1000))
    with pytest.raises(ValueError, match="cannot read the pattern"):
        clean.clean(df, drop_matching="(")


def test_cap_groups_is_exact(spark):
    df = spark.createDataFrame([("hot" if i % 4 else "cold", i) for i in range(2000)], "d string, seq long")
    kept = sampling.cap_groups(df, {"hot": 100, "cold": 10**6}, "d").collect()
    assert sum(r.d == "hot" for r in kept) == 100 and sum(r.d == "cold" for r in kept) == 500
    hot = df.where("d = 'hot'").withColumn("h", X.seeded_hash(42, F.col("seq"))).orderBy("h").limit(100)
    assert {r.seq for r in kept if r.d == "hot"} == {r.seq for r in hot.collect()}


def test_split_is_disjoint_and_complete(spark):
    df = spark.createDataFrame([("a", i, "text", 1) for i in range(60)], "dataset string, seq long, kind string, chars int")
    out = build_training_set(df, [sampling.Part("a", repeat=2)]).collect()
    sides = {}
    for r in out:
        sides.setdefault(r.seq, set()).add(r.split)
    assert len(out) == 120 and all(len(s) == 1 for s in sides.values())
    assert sum(s == {"eval"} for s in sides.values()) == int(120 * 0.05)
    few = df.limit(39)
    assert {r.split for r in sampling.split_train_eval(few).collect()} == {"train"}
    with pytest.raises(ValueError, match="images or texts"):
        sampling.check_mixable(df.unionByName(df.withColumn("kind", F.lit("image"))))


def test_packing_keeps_the_stream(spark):
    docs = [(i, [i + 1] * n) for i, n in enumerate([3, 0, 700, 5, 1, 64, 13])]
    df = spark.createDataFrame(docs, "k long, ids array<int>")
    blocks = encode.pack(df, "k", F.size("ids"), F.col("ids"), 50, min_tail=1).orderBy("block").collect()
    order = [r.k for r in df.withColumn("h", X.seeded_hash(42, F.col("k"))).orderBy("h", "k").collect()]
    stream = [t for k in order for t in dict(docs)[k]]
    assert [t for b in blocks for t in b.input_ids] == stream
    assert all(len(b.input_ids) == 50 for b in blocks[:-1])
    same = spark.createDataFrame([(i, [1, 2, 3]) for i in range(3)], "k long, ids array<int>")
    first = encode.pack(same, "k", F.size("ids"), F.col("ids"), 4, min_tail=1).orderBy("block").first()
    assert first.input_ids == [1, 2, 3, 1]


def test_rendering_trains_exactly_the_answers(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "system", "note"), (1, 4, "user", "q2"), (1, 5, "assistant", "a2")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    out = render_turns(df, HEADER_ID).orderBy("at", "turn").collect()
    trained = [p.piece for r in out for p in r.pieces if p.trainable]
    assert trained == ["a1<|eot_id|>", "a2<|eot_id|>"]
    text = {r.turn: r.text for r in out}
    assert text[3] == "[System note] note\n\n" and next(r for r in out if r.turn == 3)["at"] == 4
    assert text[0].startswith("<|begin_of_text|><|start_header_id|>system")
    last = render_turns(df, CHATML, train_on="last").collect()
    assert [p.piece for r in last for p in r.pieces if p.trainable] == ["a2<|im_end|>"]


def test_merged_turns_share_one_header(spark):
    rows = [(1, 0, "user", "a "), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    text = "".join(r.text for r in render_turns(df, TURN_TAG).orderBy("turn").collect())
    assert text == "<bos><start_of_turn>user\na\n\nb<end_of_turn>\n<start_of_turn>model\nc\n\nd<end_of_turn>\n"


def test_excluded_regions_keep_the_text(spark):
    text = "x<O>in<C>y<O>open"
    pieces = one(spark, exclude_regions(F.col("s"), [("<O>", "<C>")]), s=text)
    assert "".join(p.piece for p in pieces) == text
    assert [p.piece for p in pieces if p.trainable] == ["x<O>", "y<O>"]


def test_render_errors(spark):
    calls = F.array(*[F.struct(F.lit("f").alias("name"), F.lit("{}").alias("arguments"), F.lit(True).alias("args_is_object"))] * 2)
    assert "at most 1" in spark.range(1).select(render_error(HEADER_ID, calls)).first()[0]
    assert spark.range(1).select(render_error(CHATML, calls)).first()[0] is None
    with pytest.raises(ValueError):
        TURN_TAG.with_reasoning("native")


def test_turns_and_traces_are_inverse(spark):
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in range(4) for t in range(c + 1)], "conv_id long, turn long, role string, content string")
    records, longer = assemble_traces(turns, "conv_id", "turn", max_turns=3)
    back = explode_turns(records.withColumnRenamed("conv_id", "seq"))
    got = {(r.seq, r.pos, r.role, r.content) for r in back.select("seq", "pos", "role", "content").collect()} | {tuple(r) for r in longer.collect()}
    assert got == {tuple(r) for r in turns.collect()}
    fps = {r.conv_id: r.fp for r in turn_fingerprints(turns.withColumnRenamed("content", "text")).collect()}
    assert len(set(fps.values())) == 4


def test_ema_against_the_recurrence(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else "cold", i, rng.random() * 10) for i in range(3000)]
    got = {(r.job_id, r.step): r.smoothed for r in ema(spark.createDataFrame(rows, "job_id string, step long, loss double")).collect()}
    state = {}
    for job, step, x in rows:
        state[job] = x if job not in state else 0.9 * state[job] + 0.1 * x
        assert got[(job, step)] == pytest.approx(state[job], rel=1e-9)


def test_stage_chains(spark):
    jobs = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone")], "job_id string, init_from string")
    assert {tuple(r) for r in stage_roots(jobs).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0)}
    assert {tuple(r) for r in stage_chain(jobs, "c").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    with pytest.raises(ValueError, match="cycle"):
        stage_roots(spark.createDataFrame([("x", "y"), ("y", "x")], "job_id string, init_from string"), max_rounds=4)


def test_detection_and_import(spark):
    chats = spark.createDataFrame([(i, [("human", f"q{i % 5}"), ("gpt", f"<think>r</think>a{i % 5}")]) for i in range(10)], "seq long, conversations array<struct<`from`:string,value:string>>")
    mapping, _why = detect_mapping(chats)
    assert (mapping.layout, mapping.role_key) == ("sharegpt", "from")
    judged = import_table(chats, source="s", license="mit", keep_reasoning=False).collect()
    assert sum(r.reason is None for r in judged) == 5 and sum(r.reason == "duplicate" for r in judged) == 5
    assert judged[0].messages[1].reasoning is None and judged[0].meta_license == "mit"
    pairs = spark.createDataFrame([("q", "a", "ctx")], "Question string, answer string, context string")
    m, _ = detect_mapping(pairs)
    assert (m.layout, m.prompt, m.completion, m.input) == ("prompt_completion", "Question", "answer", "context")
    assert detect_mapping(spark.createDataFrame([(1,)], "n int"))[0] is None
    with pytest.raises(ValueError, match="no field x"):
        Mapping.from_dict({"layout": "text", "x": 1})
    assert Mapping.from_dict({"layout": "text", "text": "t"}).to_dict() == {"layout": "text", "text": "t"}


def test_preference_lists(spark):
    msg = "array<struct<role:string,content:string>>"
    rows = [(1, "p", [("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad")])]
    df = spark.createDataFrame(rows, f"seq long, prompt string, chosen {msg}, rejected {msg}")
    r = convert_table(df, Mapping(layout="preference", chosen="chosen", rejected="rejected", prompt="prompt")).first()
    assert [m.content for m in r.messages] == ["q"] and r.chosen[0].content == "good" and r.rejected[0].content == "bad" and r.valid


def test_detection_reads_json_text_of_any_column(spark):
    chat = '[{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]'
    odd = spark.createDataFrame([(f"[{i}] a note", chat if i else "[broken", "en") for i in range(30)], "text string, `pay.load` string, lang string")
    m, why = detect_mapping(odd)
    assert (m.layout, m.messages, m.role_key) == ("sharegpt", "pay.load", "from") and "pay.load" in why
    both = odd.withColumn("conversations", F.lit('[{"role": "user", "content": "q"}]'))
    assert detect_mapping(both)[0].messages == "conversations"  # the usual name first
    few = odd.withColumn("pay.load", F.when(F.col("lang") == "xx", F.col("`pay.load`")).otherwise(F.lit("[1, 2]")))
    assert detect_mapping(few)[0].text == "text"
    nulls = spark.createDataFrame([(None, None)], "text string, payload string")
    assert detect_mapping(nulls)[0].text == "text"
