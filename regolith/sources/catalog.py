"""A registry behind one interface: entities, flags and runs, each kept as a table log.

Sets go in and come out as DataFrames: a batch is one commit that rewrites the buckets of its hashes. What names one entity (read, exists,
delete) prunes by its hash where the name carries one. Another storage takes the place of this one by offering the same methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.functions import identity
from regolith.operators import annotate, browse, curate, merge, quality
from regolith.operators.table_log import BUCKETS, TableLog, bucket_of

KINDS = ("elements", "schemas", "values", "valuesets")
PROVENANCE = "array<struct<source:string,class:string,name:string,description:string>>"
ENTITY = f"sha256 string, identifier string, semantic map<string,string>, ontology_annotations array<{annotate.ANNOTATION}>, provenance {PROVENANCE}, version long"
FLAG = "sha256 string, entity_type string, entity_ref string, flag_type string, context string, status string, note string, created_at string, resolved_by string, resolved_at string, provenance array<struct<source:string,name:string>>, version long"
RUN = "sha256 string, source string, started_at string, summary string, provenance array<struct<source:string,name:string>>, version long"


def json_of(semantic: Column) -> Column:
    """A map of JSON values as a JSON object, its keys in order."""
    entries = F.array_sort(F.map_entries(semantic))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ","), F.lit("}"))


class Catalog:
    """The stores of a registry at path, made where they are not there yet."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.entities = Entities(spark, path, buckets)
        self.flags = Flags(spark, path, buckets)
        self.runs = Runs(spark, path, buckets)


def _table(spark: SparkSession, path: str, schema: str, buckets: int) -> TableLog:
    table = TableLog(spark, path)
    try:
        table.latest()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = TableLog.create(spark, path, spark.createDataFrame([], schema).schema, buckets)
    return table


class Entities:
    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets

    def table(self, kind: str) -> TableLog:
        if kind not in KINDS:
            raise ValueError(f"no kind {kind!r}; there are {', '.join(KINDS)}")
        return _table(self.spark, f"{self.path}/{kind}", ENTITY, self.buckets)

    def write_batch(self, kind: str, rows: DataFrame, name: str = "") -> int:
        """The version after rows (semantic, provenance, and any of ontology_annotations, sha256, identifier) are merged in; a named batch counts once.

        Rows without a hash get that of their identity, rows without an identifier their name and the hash's first digits.
        """
        log = self.table(kind)
        version = log.latest() + 1
        given = {c: F.col(c) if c in rows.columns else F.lit(None).cast(t) for c, t in (("sha256", "string"), ("identifier", "string"), ("ontology_annotations", f"array<{annotate.ANNOTATION}>"))}
        full = rows.select("semantic", F.col("provenance").cast(PROVENANCE).alias("provenance"), *(c.alias(n) for n, c in given.items()))
        hashed = full.withColumn("sha256", F.coalesce("sha256", identity.sha256(identity.identity_json(json_of(F.col("semantic")), F.col("provenance"), F.col("ontology_annotations")))))
        first = F.coalesce(F.get("provenance", F.lit(0))["name"], F.lit(kind))
        named = hashed.withColumn("identifier", F.coalesce("identifier", F.concat(F.lower(first), F.lit("_"), identity.short_key(F.col("sha256")))))
        return log.merge(named.withColumn("version", F.lit(version).cast("long")), name)

    def list(self, kind: str, source: str | None = None, has_annotations: bool | None = None, data_type: str | None = None) -> DataFrame:
        rows = self.table(kind).read()
        if source is not None:
            rows = rows.filter(browse.of_source(source))
        if has_annotations is not None:
            some = F.coalesce(F.size("ontology_annotations") > 0, F.lit(False))
            rows = rows.filter(some if has_annotations else ~some)
        if data_type is not None:
            rows = rows.filter(F.try_element_at("semantic", F.lit("data_type")) == F.to_json(F.array(F.lit(data_type))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(data_type)))) - 2))
        return rows

    def count(self, kind: str, **filters) -> int:
        return self.list(kind, **filters).count()

    def find(self, kind: str, ref: str) -> DataFrame:
        """The entity of a whole hash, of an identifier, or the first of a hash prefix; no row if there is none. A whole hash opens its bucket only."""
        log = self.table(kind)
        if len(ref) == 64:
            (bucket,) = self.spark.range(1).select(bucket_of(F.lit(ref), self.buckets)).first()
            return log.read(buckets=[bucket]).filter(F.col("sha256") == ref).limit(1)
        rank = F.when(F.col("identifier") == ref, 0).when(F.col("sha256").startswith(ref), 1)
        return log.read().withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank", "sha256").limit(1).drop("_rank")

    def find_by_hash(self, kind: str, short: str) -> DataFrame:
        return browse.by_prefix(self.table(kind).read(), short)

    def exists(self, kind: str, ref: str) -> bool:
        return not self.find(kind, ref).isEmpty()

    def delete(self, kind: str, ref: str) -> bool:
        hit = self.find(kind, ref).select("sha256").collect()
        if hit:
            self.table(kind).delete(self.spark.createDataFrame(hit, "sha256 string"))
        return bool(hit)

    def merge_provenance(self, kind: str, entries: DataFrame) -> int:
        """The version after entries (sha256, provenance) are united with those of rows that are there; an entry of a known source and name changes nothing."""
        log = self.table(kind)
        version = log.latest() + 1
        told = entries.groupBy("sha256").agg(F.flatten(F.collect_list(F.col("provenance").cast(PROVENANCE))).alias("_more"))
        rows = log.read().join(told, "sha256").withColumn("provenance", F.col("_more")).drop("_more")
        return log.merge(rows.withColumn("version", F.lit(version).cast("long")))

    def update(self, kind: str, changes: DataFrame) -> int:
        """The version after changes (sha256, key, value as JSON) of rows that are there; hashes stay, as keys that others hold."""
        log = self.table(kind)
        version = log.latest() + 1
        rows = log.read().join(changes.select("sha256").distinct(), "sha256", "left_semi")
        return log.merge(merge.update(rows, changes).withColumn("version", F.lit(version).cast("long")), merge=False)


class Flags:
    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.table = _table(spark, f"{path}/flags", FLAG, buckets)

    def write(self, rows: DataFrame, at: Column, name: str = "") -> int:
        """The version after flags (entity_type, entity_ref, flag_type, context) are added; what is flagged already stays as it is."""
        version = self.table.latest() + 1
        key = F.sha2(F.concat_ws("\u0001", "entity_ref", "flag_type"), 256)
        fresh = merge.keep_first(rows.withColumn("sha256", key), ["sha256"], ["entity_type"]).join(self.table.read().select("sha256"), "sha256", "left_anti")
        return self.table.merge(_as(fresh.withColumn("status", F.lit("pending")).withColumn("created_at", at.cast("string")), FLAG, version, rows.sparkSession), name)

    def read(self, status: str | None = None, flag_type: str | None = None) -> DataFrame:
        rows = self.table.read()
        for column, wanted in (("status", status), ("flag_type", flag_type)):
            if wanted is not None:
                rows = rows.filter(F.col(column) == wanted)
        return rows

    def resolve(self, decisions: DataFrame, at: Column) -> int:
        """The version after decisions (sha256, status, resolved_by, and note) on flags that are pending; decisions on others change nothing."""
        version = self.table.latest() + 1
        open_ = self.table.read().join(decisions.select("sha256").distinct(), "sha256", "left_semi").withColumnRenamed("sha256", "flag_id")
        told = decisions.withColumnRenamed("sha256", "flag_id")
        done = curate.resolve_flags(open_, told, at.cast("string")).withColumnRenamed("flag_id", "sha256")
        if "note" in decisions.columns:
            notes = merge.keep_first(decisions, ["sha256"], ["status", "resolved_by"]).select("sha256", F.col("note").alias("_note"))
            done = done.join(notes, "sha256", "left").withColumn("note", F.coalesce("_note", "note")).drop("_note")
        return self.table.merge(_as(done, FLAG, version, decisions.sparkSession), merge=False)


class Runs:
    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.table = _table(spark, f"{path}/runs", RUN, buckets)

    def save(self, rows: DataFrame) -> int:
        """The version after run summaries (run_id, source, started_at, summary as JSON)."""
        return self.table.merge(_as(rows.withColumnRenamed("run_id", "sha256"), RUN, self.table.latest() + 1, rows.sparkSession), merge=False)

    def list(self, source: str | None = None, limit: int | None = None) -> DataFrame:
        """Newest first."""
        rows = self.table.read().select(F.col("sha256").alias("run_id"), "source", "started_at", "summary")
        rows = rows if source is None else rows.filter(F.col("source") == source)
        rows = rows.orderBy(F.desc("started_at"), "run_id")
        return rows if limit is None else rows.limit(limit)

    def previous(self) -> DataFrame:
        """The newest run of each source."""
        return quality.latest(self.list(), "source", "started_at")


def _as(rows: DataFrame, schema: str, version: int, spark: SparkSession) -> DataFrame:
    fields: T.StructType = spark.createDataFrame([], schema).schema
    told = rows.withColumn("version", F.lit(version))
    return told.select(*((F.col(f.name) if f.name in told.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
