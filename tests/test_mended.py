"""Cases that once gave wrong answers: broken JSON, tools, sidecars, odd losses, long chains, caps."""

import json

import pytest
from pyspark.sql import functions as F

from trainset.functions.text import parse_json
from trainset.operators import encode, images, infer, render, runs, sampling
from trainset.operators.convert import convert_table
from trainset.operators.mapping import Mapping
from trainset.operators.traces import turn_issues
from trainset.plans.imports import import_table
from trainset.plans.samples import build_text_samples
from trainset.sources.files import read_json_document, read_raw_jsonl


def test_only_one_json_value_is_valid(spark):
    texts = ['{"text":"a"}', "[1, 2]", "1", '"x"', '{"text":"a"}] garbage', "1] [2", "1} x", "1, 2", '{"a":1}, {"b":2}', '1, "w": 2', '1}, {"v": 2', ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    good = {r["i"] for r in df.where(parse_json(F.col("t")).isNotNull()).collect()}
    assert good == {0, 1, 2, 3}


def test_tools_column_of_the_usual_name(spark):
    chat = [("human", "hi"), ("function_call", '{"name":"f","arguments":{"x":1}}'), ("observation", "ok"), ("gpt", "done")]
    tools = json.dumps([{"name": "f", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}}}])
    rows = [(1, chat, tools), (2, chat, '[{"parameters": 3}]'), (3, chat, None)]
    df = spark.createDataFrame(rows, "seq long, conversations array<struct<from:string,value:string>>, tools string")
    mapping = Mapping(layout="sharegpt", messages="conversations", role_key="from", content_key="value", tools="tools")
    got = {r["seq"]: r for r in convert_table(df, mapping).collect()}
    assert got[1]["valid"] and got[1]["tools"][0]["name"] == "f"
    assert not got[2]["valid"] and got[2]["first_error"].startswith("bad_tools")
    assert got[3]["valid"] and not got[3]["tools"]


def test_rendered_arguments_and_schemas_are_json(spark):
    calls = F.array(F.struct(F.lit("f").alias("name"), F.lit("hello").alias("arguments"), F.lit(False).alias("args_is_object")))
    text = spark.range(1).select(render.tool_call_blocks(calls)).first()[0]
    assert json.loads(text.split("\n")[1]) == {"name": "f", "arguments": "hello"}
    from trainset.schema import TOOL

    tool = {f.name: None for f in TOOL.fields} | {"name": 'a"b', "description": "d", "parameters": '{"type":"object"}', "strict": True}
    df = spark.createDataFrame([([tuple(tool[f.name] for f in TOOL.fields)],)], f"tools array<{TOOL.simpleString()}>")
    line = df.select(render.tool_json(F.get("tools", F.lit(0)))).first()[0]
    assert json.loads(line) == {"name": 'a"b', "description": "d", "parameters": {"type": "object"}, "strict": True}


def test_sidecars_and_captions_keep_one_row(spark):
    pictures = spark.createDataFrame([("d/a.png", "a"), ("d/b.png", "b")], "path string, image string")
    texts = spark.createDataFrame([("d/a.txt", " one "), ("d/a.md", "no"), ("d/b.md", "no")], "path string, text string")
    assert sorted((r["image"], r["caption"]) for r in images.join_captions(pictures, texts, "x").collect()) == [("a", "one"), ("b", "x")]
    new = spark.createDataFrame([("a", "first", 1), ("a", "a last", 2), ("b", None, 1)], "image string, caption string, n int")
    out = images.set_captions(pictures.withColumn("caption", F.lit("old")), new, order="n")
    assert sorted((r["image"], r["caption"]) for r in out.collect()) == [("a", "a last"), ("b", "old")]


def test_odd_losses(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1, 4.0), ("a", 2, None), ("a", 3, 2.0), ("b", 1, 1.0), ("b", 2, nan)] + [("b", i, 1.0) for i in range(3, 9000)]
    rows += [("c", 1, inf), ("c", 2, 1.0), ("c", 3, -inf), ("d", 1, -inf), ("d", 2, 5.0)]
    got = {(r["job_id"], r["step"]): r["smoothed"] for r in runs.ema(spark.createDataFrame(rows, "job_id string, step long, loss double")).collect()}
    assert got["a", 1] == 4.0 and abs(got["a", 3] - 3.8) < 1e-12 and ("a", 2) not in got
    assert got["b", 1] == 1.0 and all(got["b", s] != got["b", s] for s in (2, 3, 8999))
    assert got["c", 2] == inf and got["c", 3] != got["c", 3] and got["d", 2] == -inf
    every_second = [("e", i, float(i) if i % 2 else None) for i in range(1, 100)]
    trend = runs.loss_trend(spark.createDataFrame(every_second, "job_id string, step long, loss double")).collect()
    assert len(trend) == 8 and all(r["loss"] is not None for r in trend)


def test_tool_turns_after_a_call(spark):
    schema = "conv_id long, turn long, role string, text string, tool_calls array<string>"
    rows = [(1, 0, "user", "q", None), (1, 1, "assistant", "a", ["f"]), (1, 2, "tool", "r", None), (1, 3, "tool", "r", None), (1, 4, "assistant", "z", None),
            (2, 0, "user", "q", None), (2, 1, "tool", "r", None), (2, 2, "assistant", "z", None)]
    found = turn_issues(spark.createDataFrame(rows, schema)).where("code = 'orphan_tool_result'").collect()
    assert [(r["conv_id"], r["index"]) for r in found] == [(2, 1)]


def test_long_chains_and_cycles(spark):
    jobs = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "job_id long, init_from long")
    chain = {r["job_id"]: r["stage"] for r in runs.stage_chain(jobs, 149).collect()}
    assert chain == {i: i + 1 for i in range(150)}
    roots = {r["job_id"]: (r["root"], r["depth"]) for r in runs.stage_roots(jobs).collect()}
    assert roots == {i: (0, i) for i in range(150)}
    ring = spark.createDataFrame([(0, 1), (1, 0)], "job_id long, init_from long")
    with pytest.raises(ValueError):
        runs.stage_roots(ring, max_rounds=3)
    with pytest.raises(ValueError):
        runs.stage_chain(ring, 0, max_rounds=3)


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f'{{"v":"a{i}"}}' for i in range(3)))
    (tmp_path / "b.jsonl").write_text("\n".join(f'{{"v":"b{i}"}}' for i in range(500)))
    rows = read_raw_jsonl(spark, f"file://{tmp_path}").select("seq", F.try_variant_get("raw", "$.v", "string").alias("v")).orderBy("seq").collect()
    assert [r["v"] for r in rows] == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(500)]


def test_document_keys_hold_any_character(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"it's": 1, "z'\"]": [{"x": 1}, {"x": 2}], "b": [{"x": 3}]}))
    (tmp_path / "b.json").write_text(json.dumps({"it's": 1}))
    rows = read_json_document(spark, f"file://{tmp_path}/*.json").select(F.to_json("raw").alias("j")).collect()
    assert sorted(r["j"] for r in rows) == ['{"it\'s":1}', '{"x":1}', '{"x":2}']


def test_nothing_is_capped(spark):
    many = spark.range(6000).select(F.col("id").alias("seq"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    assert import_table(many, Mapping(layout="text", text="text")).where("reason IS NULL").count() == 6000
    assert sampling.sample_rows(many, 5001).count() == 5001 and sampling.sample_rows(many, 0).count() == 0
    with pytest.raises(ValueError):
        build_text_samples(many, render.CHATML, 10, "dpo")
    with pytest.raises(ValueError):
        infer.generate_candidates(many, "text", lambda p: p, k=1)
    lengths = spark.createDataFrame([(i, n) for i, n in enumerate([70000, 70001, 3, 3, 65535, 65536, 10**7])], "k long, n long")
    batches = {r["k"]: r["batch"] for r in encode.length_batches(lengths, "n", "k", 1).collect()}
    assert sorted(batches, key=batches.get)[2:] == [4, 5, 0, 1, 6]
    short = spark.createDataFrame([([1] * 23,), ([1] * 4,)], "ids array<int>")
    assert encode.chunk_text(short, "ids", 10).count() == 4 and encode.chunk_text(short, "ids", 10, min_chunk=4).count() == 3
    assert tuple(encode.chunk_report(short, F.size("ids"), 10, 4).first()) == (2, 27, 1, 3)


def test_items_of_a_long_reply_have_numbers_of_their_own(spark):
    pairs = [{"prompt": f"p{i}", "chosen": "a", "rejected": "b"} for i in range(1003)]
    replies = spark.createDataFrame([(b, json.dumps({"pairs": pairs})) for b in (0, 1)], "batch long, reply string")
    made = infer.generated_pairs(replies, "s")
    assert made.count() == 2006 and made.select("seq").distinct().count() == 2006


def test_errors_of_a_batch_stay_with_their_row(spark):
    def fails(prompts):
        if any(p == "bad" for p in prompts):
            raise RuntimeError("x" * 500)
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, "bad" if i == 5 else f"p{i}") for i in range(20)], "i int, p string").coalesce(1)
    rows = {r["i"]: (r["reply"], r["error"]) for r in infer.batch_complete(df, "p", fails, batch_size=8).collect()}
    assert rows[5] == (None, "x" * 500) and all(v[0] for i, v in rows.items() if i != 5)


def test_hold_out_is_exact_and_seeded(spark):
    df = spark.range(5000).withColumnRenamed("id", "seq")
    one, two = ({r["seq"] for r in sampling.split_train_eval(df, 0.05, 300).where("split = 'eval'").collect()} for _ in range(2))
    assert one == two and len(one) == 250
    assert sampling.split_train_eval(df, 0.05, 7).where("split = 'eval'").count() == 7
    assert sampling.split_train_eval(df.limit(39), 0.05, 300).where("split = 'eval'").count() == 0
    assert sampling.split_train_eval(df.limit(39), 0.05, 300, min_records=1).where("split = 'eval'").count() == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from trainset.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="yarn", getConf=lambda: conf)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from trainset.streaming import ingest

    source, target, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))

    def add(texts):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(source)

    def run():
        rows = spark.readStream.schema("text string").parquet(source).withColumn("ingested", F.current_timestamp())
        done = ingest.run_to_files(ingest.import_stream(rows, "ingested"), spark, "t", target=target, checkpoint=checkpoint)
        return sorted(r["text"] for r in done.select("text").collect())

    add(["one", "two"])
    assert run() == ["one", "two"]
    add(["two", "three"])
    assert run() == ["one", "three", "two"] and run() == ["one", "three", "two"]
    with pytest.raises(ValueError):
        ingest.run_to_files(spark.readStream.schema("text string").parquet(source), spark, "t", target=target)


def test_any_tokenizer_labels_what_is_trained(spark):
    import re

    from trainset.plans.samples import build_samples
    from trainset.schema import MESSAGE

    def load():
        def encode(texts):
            found = [list(re.finditer(r"\w+|\W", t)) for t in texts]
            return [([len(m[0]) * 256 + ord(m[0][0]) for m in ms], [m.start() for m in ms], [m.end() for m in ms]) for ms in found]

        return encode

    say = lambda role, text: tuple({"role": role, "content": text}.get(f.name) for f in MESSAGE.fields)
    plain = f"seq long, kind string, messages array<{MESSAGE.simpleString()}>"
    df = spark.createDataFrame([(1, "trace", [say("user", "q one"), say("assistant", "a two three")]), (2, "trace", [say("user", "q"), say("assistant", "w " * 500)])], plain)
    rows = build_samples(df, render.CHATML, "sft", 100, tokenizer=load).collect()
    assert [r["seq"] for r in rows] == [1]
    whole = "<|im_start|>user\nq one<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\na two three<|im_end|>\n"
    words = re.findall(r"\w+|\W", whole)
    assert rows[0]["input_ids"] == [len(w) * 256 + ord(w[0]) for w in words]
    learned = [w for w, label in zip(words, rows[0]["labels"]) if label != -100]
    assert "".join(learned) == "a two three<|im_end|>"
    cut = {r["seq"]: len(r["input_ids"]) for r in build_samples(df, render.CHATML, "sft", 100, "truncate", tokenizer=load).collect()}
    assert cut[2] == 100
