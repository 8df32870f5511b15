"""What outlives a job: paid replies and imported fingerprints."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trainset.operators.infer import Ledger, batch_complete
from trainset.streaming.ingest import History, checked_rows


def caller(folder, lost=None, wrong=()):
    """A model that notes each prompt; a task that meets ``lost`` for the first time dies."""

    def complete(prompts):
        import os
        import uuid

        if lost in prompts and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            raise SystemExit("the worker is lost")
        for p in prompts:
            if p in wrong:
                raise ValueError("no")
        with open(f"{folder}/{uuid.uuid4().hex}.calls", "w") as f:
            f.write("\n".join(prompts))
        return [p[::-1] for p in prompts]

    return complete


def calls(folder):
    return Counter(p for name in os.listdir(folder) if name.endswith(".calls") for p in open(f"{folder}/{name}").read().split("\n"))


def test_a_lost_task_and_a_rerun_ask_only_for_what_is_missing(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    ledger = Ledger(f"file://{tmp_path}/ledger", "model-1", rows=4)
    prompts = spark.range(40).select("id", F.concat(F.lit("p"), (F.col("id") % 30).cast("string")).alias("prompt"))
    with pytest.raises(Exception, match="lost"):
        batch_complete(prompts, "prompt", caller(str(notes), "p7"), batch_size=2, ledger=ledger)
    before = calls(notes)
    assert "p7" not in before
    answered = batch_complete(prompts, "prompt", caller(str(notes), "p7"), batch_size=2, ledger=ledger)
    assert {(r["id"], r["reply"], r["error"]) for r in answered.collect()} == {(i, f"p{i % 30}"[::-1], None) for i in range(40)}
    again = calls(notes)
    assert set(again) == {f"p{i}" for i in range(30)}
    repeated = [p for p in again if again[p] > 1]
    assert len(repeated) <= 3 * 8  # none but those of tasks that had not ended: at most one task a core
    committed = sum(again[p] == 1 and before[p] == 1 for p in again)
    assert committed == sum(before.values()) - len(repeated)
    batch_complete(prompts, "prompt", caller(str(notes)), ledger=ledger).collect()
    assert calls(notes) == again
    batch_complete(prompts.limit(1), "prompt", caller(str(notes)), ledger=Ledger(ledger.path, "model-2")).collect()
    assert sum(calls(notes).values()) == sum(again.values()) + 1


def test_a_failed_call_is_asked_for_again(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    ledger = Ledger(f"file://{tmp_path}/ledger")
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, prompt string").where("prompt is not null")
    first = {r["id"]: (r["reply"], r["error"]) for r in batch_complete(prompts, "prompt", caller(str(notes), wrong=("b",)), ledger=ledger).collect()}
    assert first == {1: ("a", None), 2: (None, "no")}
    then = {r["id"]: (r["reply"], r["error"]) for r in batch_complete(prompts, "prompt", caller(str(notes)), ledger=ledger).collect()}
    assert then == {1: ("a", None), 2: ("b", None)} and calls(notes) == {"a": 1, "b": 1}


def rows_of(spark, texts, first):
    return checked_rows(spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "seq long, text string"))


def test_history_never_forgets_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    history = History(f"file://{tmp_path}/history", 8)
    assert {r["seq"] for r in history.add(rows_of(spark, ["old", "two", "old", ""], 0), 0, "seq").collect()} == {0, 1}
    for batch in range(1, 4):
        assert history.add(rows_of(spark, [f"day {batch}", "two"], batch * 10), batch, "seq").count() == 1
    other = History(history.path, 8)
    assert other.add(rows_of(spark, ["old", "new", "new"], 90), 9, "seq").select("text").collect() == [("new",)]
    for _ in range(2):
        other.add(rows_of(spark, ["old", "new", "new"], 90), 9, "seq")
    assert sorted(r["text"] for r in history.records(spark).collect()) == ["day 1", "day 2", "day 3", "new", "old", "two"]
    assert history.fingerprints(spark).count() == 6
    assert history.add(rows_of(spark, ["old"], 99), 10, "seq").count() == 0


def test_history_is_not_shuffled(spark, tmp_path):
    history = History(f"file://{tmp_path}/history", 8)
    history.add(rows_of(spark, ["one", "two"], 0), 0, "seq")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = history.fingerprints(spark).where("batch <> 5").select("fp")
        new = rows_of(spark, ["two", "three"], 5).groupBy("fp").agg(F.min("seq").alias("seq"))
        plan = new.join(seen, "fp", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan.index("fingerprints") if "fingerprints" in plan else plan.index("history_")
    right = plan[plan.index("Join") :]
    assert right.count("Exchange hashpartitioning") == 1, plan  # of the batch, not of the history
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan, scan


def test_a_stream_goes_on_from_its_history(spark, tmp_path):
    history, source = History(f"file://{tmp_path}/history", 4), f"file://{tmp_path}/in"
    schema = "seq long, text string"
    for day, texts in enumerate((["a", "b", "a"], ["b", "c"], ["a", "d"])):
        spark.createDataFrame([(day * 10 + i, t) for i, t in enumerate(texts)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        writer = stream.writeStream.foreachBatch(history.sink("seq")).option("checkpointLocation", f"file://{tmp_path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["text"] for r in history.records(spark).collect()) == ["a", "b", "c", "d"]
