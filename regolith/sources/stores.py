"""Registry tables on disk: partitioned Parquet, exports with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("elements", "schemas", "values", "valuesets", "transforms")


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Entities by type and source; a source's file name part has no separators. Overwriting replaces only the partitions written."""
    safe = rows.withColumn("source", F.translate("source", "/\\", "__"))
    safe.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("entity_type", "source").parquet(path)


def read(spark: SparkSession, path: str, entity_type: str | None = None, source: str | None = None) -> DataFrame:
    """Entities, of one type or source by pruning partitions."""
    rows = spark.read.parquet(path)
    for column, wanted in (("entity_type", entity_type), ("source", source)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    return rows


def index(rows: DataFrame) -> DataFrame:
    """(sha256, source, file): where each entity lies."""
    return rows.select("sha256", "source", F.input_file_name().alias("file"))


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table and a manifest; returns the manifest (entity_type, n, checksum)."""
    manifest = None
    for kind, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{kind}")
        back = rows.sparkSession.read.parquet(f"{path}/{kind}")
        one = back.agg(F.lit(kind).alias("entity_type"), F.count("*").alias("n"), F.hex(F.expr("bit_xor(xxhash64(*))")).alias("checksum"))
        manifest = one if manifest is None else manifest.unionByName(one)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def validate(spark: SparkSession, path: str) -> DataFrame:
    """(entity_type, problem) of an export: a table that is not there, or whose rows or checksum differ."""
    manifest = spark.read.schema("entity_type string, n bigint, checksum string").json(f"{path}/manifest")
    out = []
    for r in manifest.collect():  # one row a kind
        try:
            got = spark.read.parquet(f"{path}/{r.entity_type}").agg(F.count("*"), F.hex(F.expr("bit_xor(xxhash64(*))"))).first()
            if got[0] != r.n or got[1] != r.checksum:
                out.append((r.entity_type, "differs"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out.append((r.entity_type, "missing"))
    return spark.createDataFrame(out, "entity_type string, problem string")
