import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from trainset.operators import images as M
from trainset.sources import files
from trainset.sources.images import header_size, read_image_folder
from trainset.streaming import ingest, metrics as SM


def png(w, h, salt=b""):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    body = zlib.compress(b"".join(b"\0" + b"\0\0\0" * w for _ in range(h)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"k\0" + salt) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def test_jsonl_lines_and_bad_json(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    path.write_text('{"text": "a"}\n\n{broken\n[1]\n{"text": "b"} tail\n{"text": "c"}\n', encoding="utf-8")
    rows = files.read_raw_jsonl(spark, str(path)).orderBy("line").collect()
    assert [r.line for r in rows] == [1, 3, 4, 5, 6] and [r.raw is None for r in rows] == [False, True, False, True, False]
    assert files.read_objects(spark, str(path)).count() == 2
    assert files.count_lines(spark, str(path)).first()[0] == 5
    assert [r.text for r in files.read_records(spark, str(path)).orderBy("seq").collect()] == ["a", "c"]
    with pytest.raises(ValueError, match="invalid_json"):
        files.read_records(spark, str(path), mode="failfast")


def test_write_append_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä\n"), (2, None)], "id long, text string")
    out = str(tmp_path / "out.jsonl")
    files.write_jsonl(df, out, gzip=True)
    files.append_jsonl(df, out)
    values = sorted(r.value for r in spark.read.text(out).collect())
    assert values == ['{"id":1,"text":"ä\\n"}'] * 2 + ['{"id":2}'] * 2


@pytest.mark.parametrize("doc,n", [([{"a": 1}, 2, {"a": 3}], 2), ({"m": 1, "z": [{"a": 1}], "b": [{"x": 1}, {"x": 2}]}, 1), ({"a": 1}, 1)])
def test_json_documents(spark, tmp_path, doc, n):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc))
    assert files.read_source(spark, str(path)).count() == n


def test_delimited_and_text_folder(spark, tmp_path):
    (tmp_path / "rows.csv").write_text('a,b\n1,"x\ny"\n2,"q ""z"""\n')
    rows = files.read_source(spark, str(tmp_path / "rows.csv")).orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [("1", "x\ny"), ("2", 'q "z"')]
    folder = tmp_path / "texts"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("one\ntwo")
    (folder / "sub" / "b.md").write_text("three")
    (folder / "c.bin").write_text("no")
    assert sorted((r.file, r.text) for r in files.read_source(spark, str(folder)).collect()) == [("a.txt", "one\ntwo"), ("b.md", "three")]
    assert files.read_source(spark, str(folder), max_rows=1).count() == 1
    with pytest.raises(ValueError):
        files.read_source(spark, "x.xlsx")


def test_image_folder(spark, tmp_path):
    for name, data in {"a.png": png(4, 2), "b.png": png(4, 2), "c.PNG": png(3, 5, b"x"), "broken.jpg": b"\xff\xd8nope", "d.gif": b"GIF89a\x01\x00\x01\x00"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "a.txt").write_text(" a cat \n")
    judged = M.image_records(read_image_folder(spark, str(tmp_path)), "local:x")
    by_name = {r.name: r for r in judged.collect()}
    assert {n: r.reason for n, r in by_name.items()} == {"a.png": None, "b.png": "duplicate", "c.PNG": None, "broken.jpg": "unreadable"}
    assert (by_name["c.PNG"].width, by_name["c.PNG"].height) == (3, 5)
    kept = judged.where("reason IS NULL")
    captioned = {r.name: r.caption for r in M.join_captions(kept, files.read_text_folder(spark, str(tmp_path)), "none").collect()}
    assert captioned == {"a.png": "a cat", "c.PNG": "none"}
    assert M.cap_images(judged, 1).count() == 1
    assert header_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)) == ("bmp", 7, 9) and header_size(None) is None


def test_buckets(spark):
    buckets = M.buckets_for(1024)
    assert buckets[0] == (1024, 1024) and len(buckets) == 7 and all(h % 32 == 0 and w % 32 == 0 for h, w in buckets)
    df = spark.createDataFrame([(100, 100), (900, 1600), (1600, 900)], "h int, w int")
    got = [r[0] for r in df.select(M.assign_bucket(F.col("h"), F.col("w"), buckets)).collect()]
    assert got[0] == "1024x1024" and got[1].split("x")[::-1] == got[2].split("x")


def metric(job, minute, step, loss):
    return json.dumps({"job_id": job, "time": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00+0000", "step": step, "loss": loss})


def test_metric_streams(spark, tmp_path):
    import os
    import time

    log = tmp_path / "log"
    log.mkdir()
    lines = [[metric("a", 0, 1, 4.0), metric("a", 1, 2, 2.0)], [metric("b", 300, 1, 1.0)], [metric("b", 301, 2, 3.0)]]
    for i, batch in enumerate(lines):
        (log / f"{i}.json").write_text("\n".join(batch))
        stamp = time.time() - 100 + i
        os.utime(log / f"{i}.json", (stamp, stamp))
    stream = lambda: SM.read_metrics(spark, str(log), "1 minute", max_files=1)
    smooth = ingest.run_to_files(SM.ema_stream(stream()), spark, "t-ema", mode="update")
    last = {r.job_id: r.smoothed for r in smooth.groupBy("job_id").agg(F.max_by("smoothed", "step").alias("smoothed")).collect()}
    assert last["a"] == pytest.approx(3.8) and last["b"] == pytest.approx(1.2)
    stale = ingest.run_to_files(SM.stale_jobs_stream(stream(), 30 * 60 * 1000), spark, "t-stale").collect()
    assert [r.job_id for r in stale] == ["a"]


def test_manifest_of_nothing_and_the_last_of_a_name(spark, tmp_path):
    from trainset.operators.mapping import Mapping
    from trainset.plans.imports import import_table
    from trainset.operators.traces import record_summary
    from trainset.sources.profile import append_manifest, load_manifest, manifest_row, with_statistics

    mapping, path = Mapping(layout="text", text="text"), str(tmp_path / "manifests")
    rows = [(1, "one two"), (2, "one two"), (3, None), (4, "three")]
    for data in (rows[:1], rows, []):
        judged = import_table(spark.createDataFrame(data, "seq long, text string"), mapping, source="s")
        full = with_statistics(manifest_row(judged, "none" if not data else "a", "x", None, mapping), record_summary(judged.where("reason IS NULL")))
        append_manifest(full, path)
    last = load_manifest(spark, path, "a").first()
    assert (last["read"], last["records"], last["stats"]["records"], last["stats"]["chars_max"]) == (4, 2, 2.0, 7.0)
    assert [(c["field"], c["value"], c["n"]) for c in last["common"]] == [("meta_source", "s", 2)]
    none = load_manifest(spark, path, "none").first()
    assert none["stats"]["records"] == 0.0 and none["common"] == [] and load_manifest(spark, path, "b").count() == 0
