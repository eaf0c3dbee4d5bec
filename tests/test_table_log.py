"""The table log: touched buckets, retries, a crash before the pointer, older versions."""

import os

import pytest
from pyspark.sql import functions as F

from regolith.operators import table_log
from regolith.operators.merge import upsert
from regolith.operators.table_log import TableLog
from regolith.streaming.commit import commit_stream

SCHEMA = "sha256 string, name string, version long, provenance array<struct<source:string,name:string>>"


def frame(spark, rows):
    """rows: (sha256, name, version, source)"""
    return spark.createDataFrame([(h, n, v, [(s, n)]) for h, n, v, s in rows], SCHEMA)


def state(df):
    return sorted((r.sha256, r.name, r.version, [(p.source, p.name) for p in r.provenance]) for r in df.collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return TableLog.create(spark, f"file://{tmp_path}/t", frame(spark, []).schema, 16)


FIRST = [(f"h{i}", f"n{i}", 1, "a") for i in range(60)]


def test_same_as_upserts_of_whole_tables(spark, table):
    second = [(f"h{i}", f"m{i}", 2, "b") for i in range(50, 70)] + [("h3", "m3", 2, "b")]
    assert table.latest() == 0 and table.read().collect() == []
    assert table.merge(frame(spark, FIRST)) == 1 and table.merge(frame(spark, second)) == 2
    want = upsert(frame(spark, FIRST), frame(spark, second))
    assert state(table.read()) == state(want)
    assert state(table.read(1)) == state(frame(spark, FIRST)) and table.read(0).collect() == []
    with pytest.raises(ValueError):
        table.read(9)
    with pytest.raises(Exception):
        TableLog.create(spark, table.path, frame(spark, []).schema)


def test_a_batch_rewrites_its_own_buckets_only(spark, table, tmp_path):
    table.merge(frame(spark, FIRST))
    before = files(tmp_path / "t/data")
    table.merge(frame(spark, [("h3", "new", 2, "b")]))
    fresh = files(tmp_path / "t/data") - before
    (bucket,) = {f.split("bucket=")[1].split("/")[0] for f in fresh}
    (own,) = spark.range(1).select(table_log.bucket_of(F.lit("h3"), 16)).first()
    assert int(bucket) == own and before <= files(tmp_path / "t/data")
    touched = [r.sha256 for r in spark.createDataFrame(FIRST, "sha256 string, a string, b int, c string").filter(table_log.bucket_of(F.col("sha256"), 16) == own).collect()]
    assert sorted(r.sha256 for r in table.read(buckets=[own]).collect()) == sorted(touched)


def test_a_named_batch_is_applied_once(spark, table):
    assert table.merge(frame(spark, FIRST), "b1") == 1
    assert table.merge(frame(spark, [("h1", "again", 9, "z")]), "b1") == 1
    assert state(table.read()) == state(frame(spark, FIRST))


def test_a_writer_that_dies_before_the_pointer_changes_nothing(spark, table, tmp_path, monkeypatch):
    table.merge(frame(spark, FIRST), "b1")
    with monkeypatch.context() as m:
        m.setattr(table, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("the writer dies")))
        with pytest.raises(RuntimeError):
            table.merge(frame(spark, [("h1", "lost", 2, "b")]), "b2")
    assert state(TableLog(spark, table.path).read()) == state(frame(spark, FIRST))
    assert table.merge(frame(spark, [("h1", "kept", 2, "b")]), "b2") == 2
    assert [r.name for r in table.read().filter("sha256 = 'h1'").collect()] == ["kept"]
    assert [(r.version, r.batch) for r in table.versions().orderBy("version").collect()] == [(0, ""), (1, "b1"), (2, "b2")]


def test_delete_and_compact(spark, table):
    table.merge(frame(spark, FIRST))
    table.merge(frame(spark, [("h1", "x", 2, "b"), ("", "no hash", 1, "b"), ("", "no hash", 1, "b")]))
    kept = state(table.read())
    assert table.compact() == 3 and state(table.read()) == kept and len([k for k in kept if k[0] == ""]) == 2
    gone = spark.createDataFrame([(f"h{i}",) for i in range(60)] + [("absent",)], "sha256 string")
    table.delete(gone)
    assert [r[0] for r in state(table.read())] == ["", ""] and state(table.read(3)) == kept


def test_stream_of_batches(spark, table, tmp_path):
    source = tmp_path / "staged"
    for k, rows in enumerate([FIRST[:30], FIRST[20:] + [("h0", "later", 5, "c")]]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{source}")
        commit_stream(stream, table, f"file://{tmp_path}/checkpoint").awaitTermination(120)
        assert table.latest() == k + 1
    assert state(table.read()) == state(upsert(frame(spark, FIRST[:30]), frame(spark, FIRST[20:] + [("h0", "later", 5, "c")])))
