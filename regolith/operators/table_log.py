"""A registry table that batches are merged into: buckets by hash, copied where a batch touches them, behind one snapshot pointer.

    path/data/commit=<id>/bucket=<n>/   rows; a commit holds the buckets that its batch touched, whole
    path/log/version=<n>/               one small file: which commit holds each bucket, and the batch that made the version

A batch reads and rewrites the buckets of its own hashes and no others. It becomes visible by the one file in `log` that is
written last, and which a reader sees or does not; a writer that dies before leaves a commit that no version names, and may be run again. A batch that
carries a name is applied once, however often it is delivered. Every version stays readable. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import upsert

BUCKETS = 64
_POINTERS = "bucket int, commit string, batch string, buckets int, columns string"


def bucket_of(sha: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(sha, F.lit(""))), F.lit(buckets)).cast("int")


class TableLog:
    """A table of the registry envelope (sha256, provenance, version, ...) at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS) -> TableLog:
        """An empty table; one that is there already is an error."""
        table = cls(spark, path)
        loose = schema.json()  # batches need not agree on what may be null
        for told in ("nullable", "containsNull", "valueContainsNull"):
            loose = loose.replace(f'"{told}":false', f'"{told}":true')
        table._point(0, {}, "", buckets, T.StructType.fromJson(json.loads(loose)), "errorifexists")
        return table

    def versions(self) -> DataFrame:
        """(version, batch, buckets_held) of all snapshots."""
        return self._log().groupBy("version").agg(F.max("batch").alias("batch"), F.count("commit").alias("buckets_held"))

    def latest(self) -> int:
        return self._log().agg(F.max("version")).first()[0]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a snapshot, the latest if none is named; of some buckets, if they are named."""
        held, _, schema = self._snapshot(self.latest() if version is None else version)
        paths = [f"{self.path}/data/commit={c}/bucket={b}" for b, c in sorted(held.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def merge(self, batch: DataFrame, name: str = "", merge: bool = True, order: str = "version") -> int:
        """The version after a batch is upserted on sha256; the version that is there, if a batch of that name was applied before."""
        if name:
            done = self._log().filter(F.col("batch") == name).agg(F.max("version")).first()[0]
            if done is not None:
                return done
        at = self.latest()
        held, buckets, schema = self._snapshot(at)
        touched = [r.b for r in batch.select(bucket_of(F.col("sha256"), buckets).alias("b")).distinct().collect()]  # at most all buckets
        rows = upsert(self.read(at, touched), batch, order, merge)
        return self._commit(at, held, touched, rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)), name, buckets, schema)

    def delete(self, hashes: DataFrame, name: str = "") -> int:
        """The version after rows of some hashes (sha256) are gone."""
        at = self.latest()
        held, buckets, schema = self._snapshot(at)
        touched = [b for b in (r.b for r in hashes.select(bucket_of(F.col("sha256"), buckets).alias("b")).distinct().collect()) if b in held]
        rows = self.read(at, touched).join(hashes.select("sha256").distinct(), "sha256", "left_anti")
        return self._commit(at, held, touched, rows.select(*schema.names), name, buckets, schema)

    def compact(self) -> int:
        """The version after all buckets are written anew by one commit, each as one file; what small batches scattered lies together."""
        at = self.latest()
        held, buckets, schema = self._snapshot(at)
        return self._commit(at, held, sorted(held), self.read(at), "", buckets, schema)

    def _commit(self, at: int, held: dict[int, str], touched: list[int], rows: DataFrame, name: str, buckets: int, schema: T.StructType) -> int:
        commit = uuid.uuid4().hex
        target = f"{self.path}/data/commit={commit}"
        if touched:
            placed = rows.withColumn("bucket", bucket_of(F.col("sha256"), buckets))
            placed.repartition(min(len(touched), buckets), "bucket").write.partitionBy("bucket").parquet(target)
            filled = {r.bucket for r in self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(target).select("bucket").distinct().collect()}
            held = {b: c for b, c in held.items() if b not in touched} | dict.fromkeys(filled, commit)
        self._point(at + 1, held, name, buckets, schema, "errorifexists")
        return at + 1

    def _point(self, version: int, held: dict[int, str], name: str, buckets: int, schema: T.StructType, mode: str) -> None:
        rows = [(b, c, name, buckets, schema.json()) for b, c in sorted(held.items())] or [(None, None, name, buckets, schema.json())]
        self.spark.createDataFrame(rows, _POINTERS).coalesce(1).write.mode(mode).parquet(f"{self.path}/log/version={version}")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(f"{_POINTERS}, version int").parquet(f"{self.path}/log")

    def _snapshot(self, version: int) -> tuple[dict[int, str], int, T.StructType]:
        rows = self._log().filter(F.col("version") == version).collect()
        if not rows:
            raise ValueError(f"no version {version}")
        return {r.bucket: r.commit for r in rows if r.commit}, rows[0].buckets, T.StructType.fromJson(json.loads(rows[0].columns))
