"""The registry format: the same rows as Spark's own reader, folders chosen by filters, and a stream of what comes."""

import pytest
from pyspark.sql import functions as F

from regolith.sources import registry_source, stores
from regolith.sources.documents import entities


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("string").alias("n"), F.when(F.col("id") % 2 == 0, "element").otherwise("schema").alias("k"), F.concat(F.lit("s/"), (F.col("id") % 3).cast("string")).alias("s"))
    stores.write(entities(rows, entity_type=F.col("k"), source=F.col("s"), name=F.col("n"), options=F.array(F.col("n")), min_value=F.col("n").cast("double")), f"file://{tmp_path}/store")
    registry_source.register(spark)
    return f"file://{tmp_path}/store"


def rows(df):
    return sorted((r.entity_type, r.source, r.name, tuple(r.options), r.min_value) for r in df.collect())


def test_same_rows_as_parquet(spark, folder):
    got = spark.read.format("registry").load(folder)
    assert rows(got) == rows(spark.read.parquet(folder)) and got.count() == 60
    assert rows(got.filter("entity_type = 'schema' and name > '3'")) == rows(spark.read.parquet(folder).filter("entity_type = 'schema' and name > '3'"))
    assert got.filter("source in ('s_1', 's_2') and source = 's_1'").count() == 20 and got.filter("source = 'none'").count() == 0
    assert [r["name"] for r in got.select("name").filter("source = 's_0' and entity_type = 'element'").orderBy(F.col("name").cast("int")).limit(2).collect()] == ["0", "6"]


def test_filters_choose_folders(spark, folder, capsys):
    reader = registry_source.RegistrySource({"path": folder}).reader(spark.read.format("registry").load(folder).schema)
    every = [f for p in reader.partitions() for f in p.files]
    rest = list(reader.pushFilters([registry_source.EqualTo(("entity_type",), "element"), registry_source.In(("source",), ("s_0", "s_1")), registry_source.EqualTo(("name",), "6")]))
    assert [f.attribute for f in rest] == [("name",)]
    some = [f for p in reader.partitions() for f in p.files]
    assert {f[1:] for f in some} == {("element", "s_0"), ("element", "s_1")} and len({f[1:] for f in every}) == 6
    spark.read.format("registry").load(folder).filter("entity_type = 'element' and name = '6'").explain()
    plan = capsys.readouterr().out
    assert "BatchScan" in plan and "entity_type" not in plan.split("Filter", 1)[1].split("\n")[0]  # the reader has taken the filter on types


def test_partitions_by_size(folder, monkeypatch):
    found = registry_source.files_of(folder, {})
    monkeypatch.setattr(registry_source, "PARTITION_BYTES", max(f.size for f in found))
    assert len(registry_source.partitions_of(found)) == len(found) and registry_source.partitions_of([]) == []


def test_stream_of_what_comes(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("registry").load(folder).select("name")
        q = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(f"file://{tmp_path}/out").count()

    assert run() == 60
    stores.write(entities(spark.range(5), entity_type="element", source="late", name=F.col("id").cast("string")), folder)
    assert run() == 65 and run() == 65
