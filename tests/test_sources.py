"""Readers, writers and streams on small files."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.sources import files, sinks
from lectern.streaming import state


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.txt", "hello" * 100)
        z.writestr("d/y.bin", b"\0\1")
    got = {r["name"]: bytes(r["content"]) for r in files.zip_members(spark, str(tmp_path / "a.zip")).collect()}
    assert got == {"x.txt": b"hello" * 100, "d/y.bin": b"\0\1"}


def test_lines_and_records(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿$===\r\none\r\n$===\r\ntwo".encode())
    got = files.lines(spark, str(tmp_path / "a.txt")).withColumn("i", F.monotonically_increasing_id())
    out = files.records(got, "line", "i", "file", "$=").orderBy("i").collect()
    assert [(r["line"], r["record"]) for r in out] == [("$===", 1), ("one", 1), ("$===", 2), ("two", 2)]


def test_tables_in_text(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").agg(F.sum("a")).first()[0] == 3
    (tmp_path / "b.tsv").write_text("Gen.1.1\tJohn.1.1\t5\n")
    assert files.tab_separated(spark, str(tmp_path / "b.tsv"), "f string, t string, votes int").first()["votes"] == 5
    (tmp_path / "bad.tsv").write_text("a\tb\tmany\n")
    with pytest.raises(Exception):
        files.tab_separated(spark, str(tmp_path / "bad.tsv"), "f string, t string, votes int").collect()
    (tmp_path / "c.xml").write_text("<r><entry n='1'><k>a</k></entry><entry n='2'><k>b</k></entry></r>")
    assert {r["k"] for r in files.xml_entries(spark, str(tmp_path / "c.xml"), "entry").collect()} == {"a", "b"}


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.range(250).withColumn("k", F.col("id") % 3)
    sinks.numbered_buckets(df, str(tmp_path / "b"), "id")
    assert spark.read.parquet(str(tmp_path / "b")).where("bucket = 1").count() == 100
    sinks.sorted_files(df, str(tmp_path / "s"), "id", 60)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 250
    (tmp_path / "m").mkdir()
    parts = []
    for name in ("a", "b"):
        (tmp_path / "m" / name).write_text(name * 3)
        parts.append(f"{name} {hashlib.sha256((name * 3).encode()).hexdigest()}")
    got = sinks.manifest(spark, str(tmp_path / "m")).first()
    assert tuple(got) == (2, 6, hashlib.sha256("\n".join(parts).encode()).hexdigest())


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:10", 1, "x"), ("a", "2024-01-01 00:00:50", 3, "y"), ("a", "2024-01-01 00:09:00", 2, "z"), ("b", "2024-01-01 00:30:00", 1, "w")]
    spark.createDataFrame(rows, "k string, t string, v long, s string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("k string, t timestamp, v long, s string").parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sum(r["n"] for r in run(state.windowed_counts(read(), "t", "k", "1 minute", "5 minutes"), "append", "w")) == 3
    assert sorted(r["n"] for r in run(state.sessions(read(), "t", "k", "5 minutes", "1 minute"), "append", "s")) == [1, 2]
    assert {(r["k"], r["v"], r["s"]) for r in run(state.upserted(read(), "k", "v", "s"), "update", "u")} == {("a", 3, "y"), ("b", 1, "w")}
