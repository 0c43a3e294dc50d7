"""Readers, writers and streams on small files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tracelode import sources as Q
from tracelode import streaming


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source_id": "s", "page_number": 1, "text": "x"}\n\n{"source_id": "s", "page_number": 2}\n')
    got = Q.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", Q.PAGE).orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in got] == [(1, "x"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"source_id": "s"}\n[1]\nnot\n\n')
    assert [r.line for r in Q.bad_lines(spark, f"file://{tmp_path}/b.jsonl").collect()] == ["[1]", "not"]


def test_json_version(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"schema_version": "v1",\n"x": 1}')
    assert Q.read_json(spark, f"file://{tmp_path}/a.json", version="v1").count() == 1
    with pytest.raises(Exception, match="schema_version"):
        Q.read_json(spark, f"file://{tmp_path}/a.json", version="v2").collect()


def _samples(tmp_path, error="1.0"):
    head = [f.name for f in Q.sample_schema()]
    row = {n: "0" for n in head} | {"front_image": "front/0.jpg", "wrist_image": "wrist/0.jpg", "action_gripper": "1.0", "tracking_error_gripper": error, "elapsed_ns": "500000000"}
    folder = tmp_path / "ep1"
    folder.mkdir(exist_ok=True)
    (folder / "samples.csv").write_text("﻿" + ",".join(head) + "\n" + ",".join(row[n] for n in head) + "\n", encoding="utf-8")
    return f"file://{folder}/samples.csv"


def test_samples(spark, tmp_path):
    r = Q.read_samples(spark, _samples(tmp_path)).first()
    assert (r.episode_id, r.timestamp_sec, r.action[5]) == ("ep1", 0.5, 1.0)
    with pytest.raises(Exception, match="signal contract"):
        Q.read_samples(spark, _samples(tmp_path, "0.9")).collect()


def test_other_encoding(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("episode_id,failure_reason\n1,夹起时推动方块\n".encode("gb18030"))
    assert Q.read_manifest_csv(spark, f"file://{tmp_path}/m.csv").first().failure_reason == "夹起时推动方块"


def test_binary_and_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\x0ctwo  words")
    got = Q.bind_sources(spark, f"file://{tmp_path}/a.bin").first()
    assert got.sha256 == hashlib.sha256(b"one\x0ctwo  words").hexdigest() and got.size_bytes == 14
    docs = spark.createDataFrame([("s", bytearray(b"one\x0ctwo  words"))], "source_id string, content binary")
    pages = Q.split_pages(docs, lambda c: c.decode().split("\x0c")).orderBy("page_number").collect()
    assert [(r.page_number, r.text, r.char_count) for r in pages] == [(1, "one", 3), (2, "two words", 9)]
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (640).to_bytes(4) + (480).to_bytes(4)
    size = spark.createDataFrame([(bytearray(png),), (bytearray(b"x"),)], "c binary").select(Q.image_size(F.col("c"))).collect()
    assert tuple(size[0][0]) == (640, 480) and size[1][0] is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "id int, reasons array<string>, note string")
    Q.write_csv(df, f"file://{tmp_path}/c", ("reasons",))
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").first().reasons == "a|b"
    Q.write_jsonl(df, f"file://{tmp_path}/j", one_file=True)
    assert '"note":null' in spark.read.text(f"file://{tmp_path}/j").first()[0]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "x", True), (2, "x", False)], "id int, v string, edited boolean")
    new = spark.createDataFrame([(1, "n", False), (2, "n", False), (3, "n", False)], "id int, v string, edited boolean")
    got = {r.id: r.v for r in Q.upsert(old, new, "id", "edited").collect()}
    assert got == {1: "x", 2: "n", 3: "n"}


def test_stream_equals_batch(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "source_id string, page_number int, text string"
    for k in range(2):
        spark.createDataFrame([("s", k, f" page  {k} ")], schema).write.mode("append").parquet(src)
        streaming.append_pages(spark, src, schema, out, f"file://{tmp_path}/cp")
    got = sorted((r.page_number, r.text, r.char_count) for r in spark.read.parquet(out).collect())
    assert got == [(0, "page 0", 6), (1, "page 1", 6)]
