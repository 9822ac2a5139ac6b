"""Sources, sinks, scalar functions and the streaming addition."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars as X
from strandline.sources import manifests as M
from strandline.sources.sinks import Ledger, export_csv, write_manifest
from strandline.streaming import jobs


def test_inputs(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("url,speakers,note\n# a comment\nhttps://a/1,one,\n\nhttps://a/2,N,hello\n", encoding="utf-8-sig")
    assert [tuple(r) for r in M.read_inputs(spark, str(path)).collect()] == [("https://a/1", "1", ""), ("https://a/2", "n", "hello")]
    path.write_text("url,speakers,note\nhttps://a/1,seven,\n")
    with pytest.raises(Exception, match="unknown number of speakers"):
        M.read_inputs(spark, str(path)).collect()


def bundle(folder, rows, kind="kind-v1"):
    folder.mkdir(parents=True)
    text = "".join(json.dumps(r) + "\n" for r in rows)
    (folder / "manifest.jsonl").write_text(text)
    (folder / "receipt.json").write_text(json.dumps({"schema": kind, "rows": len(rows), "manifest_sha256": hashlib.sha256(text.encode()).hexdigest()}))


SCHEMA = "id string, sha256 string, spans array<struct<a:double,b:double>>"


def test_bundles_and_parts(spark, tmp_path):
    bundle(tmp_path / "part_2", [{"id": "b", "sha256": "y", "spans": None}])
    bundle(tmp_path / "part_1" / "nested", [{"id": "a", "sha256": "x", "spans": []}])
    parts = M.list_parts(spark, str(tmp_path))
    assert [n for n, _ in parts] == ["part_1", "part_2"]
    rows = M.union_parts([(n, M.load_bundle(spark, p, SCHEMA, "kind-v1")) for n, p in parts])
    assert {(r["id"], r["dataset_part"], r["spans"] is None) for r in rows.collect()} == {("a", "part_1", False), ("b", "part_2", True)}
    with pytest.raises(M.SourceError):
        M.load_bundle(spark, parts[0][1], SCHEMA, "kind-v2")
    with pytest.raises(M.SourceError):
        M.list_parts(spark, str(tmp_path), ["../part_1"])
    with pytest.raises(M.SourceError):
        M.union_parts([("a", rows.drop("dataset_part")), ("b", rows.drop("dataset_part"))])


def test_layers(spark):
    a, b = (spark.createDataFrame(r, "k string, v string") for r in ([("x", "1")], [("x", "2"), ("y", "2")]))
    assert {tuple(r) for r in M.layered([a, b], "k").collect()} == {("x", "1"), ("y", "2")}


def test_manifest_sink_refuses_nan(spark, tmp_path):
    write_manifest(spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double"), str(tmp_path / "ok"))
    assert M.read_manifest(spark, str(tmp_path / "ok"), "k string, v double").count() == 2
    with pytest.raises(Exception, match="not a number"):
        write_manifest(spark.createDataFrame([("a", float("nan"))], "k string, v double"), str(tmp_path / "bad"))


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0], "m"), ("b", None, "m")], "k string, face array<double>, meta string")
    export_csv(df, str(tmp_path / "c"), vectors=["face"], drop=["meta"])
    assert {(r["k"], r["face"]) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {("a", "yes"), ("b", None)}


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    ledger.write("t", rows(("a", 1), ("b", 2)))
    ledger.put("t", rows(("b", 3), ("c", 4)), ["k"])
    assert {tuple(r) for r in ledger.table("t").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    with pytest.raises(RuntimeError), ledger.transaction():
        ledger.write("t", rows(("z", 0)))
        ledger.write("u", rows(("z", 0)))
        raise RuntimeError("stop")
    assert ledger.table("t").count() == 3 and ledger.table("u") is None
    ledger.log("step", "done")
    assert ledger.table("events").count() == 1
    ledger.keep(1)
    assert len(ledger.snapshots()) == 1 and ledger.table("t").count() == 3


def test_links(spark):
    links = ["https://www.youtube.com/watch?v=abcdefghijk&t=1", "https://youtu.be/abcdefghijk", "https://x.org/shorts/abcdefghijk?x", "https://x.org/playlist?list=1", "https://x.org/@someone", "about"]
    df = spark.createDataFrame([(u,) for u in links], "u string").select(X.video_id(F.col("u")).alias("i"), X.classify_link(F.col("u")).alias("c"))
    assert [tuple(r) for r in df.collect()] == [("abcdefghijk", "video")] * 3 + [(None, "playlist"), (None, "channel"), (None, "other")]


def test_stream_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for values in ([("a", 1)], [("a", 2), ("b", 5)]):
        spark.createDataFrame(values, "k string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        records = jobs.read_records(spark, str(tmp_path / "in"), "k string, v int")
        jobs.upsert_into(records, ledger, "jobs", "k", str(tmp_path / "marks")).awaitTermination()
    assert {tuple(r) for r in ledger.table("jobs").collect()} == {("a", 2), ("b", 5)}
