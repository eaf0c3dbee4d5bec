"""Shared by the readers: whole files as rows, JSON as variants, and the extraction envelope.

Readers return one row for each extracted entity, ENTITY columns, nulls where a source says nothing. Files are read by
Spark, one row a file; objects are opened with variant_explode, so that keys become rows inside the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = {
    "entity_type": "string", "source": "string", "class": "string", "name": "string", "description": "string", "data_type": "string",
    "type_ref": "string", "unit": "string", "pattern": "string", "min_value": "double", "max_value": "double", "required": "boolean",
    "multivalued": "boolean", "options": "array<string>", "members": "array<string>", "ontology_id": "string", "confidence": "double", "file": "string",
}


def entities(rows: DataFrame, **columns: Column | str | float) -> DataFrame:
    """rows as ENTITY rows: what is given, and nulls."""
    def one(name, kind):
        c = columns.get(name)
        value = c if isinstance(c, Column) else F.lit(c)
        return value.cast(kind).alias(name)

    return rows.select(*(one(n, k) for n, k in ENTITY.items()))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, text of each file under path."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def json_files(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """file, doc (variant) of each JSON file; files that are no JSON are left out."""
    return whole_files(spark, path, pattern).select("file", F.try_parse_json("text").alias("doc")).filter("doc is not null")


def each(rows: DataFrame, value: Column, key: str, item: str) -> DataFrame:
    """rows with the keys and values of an object (or the values of an array) of a variant; empty ones give no rows."""
    spark = rows.sparkSession
    found = rows.withColumn("_v", value).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
    return found.select(*rows.columns, F.col("key").alias(key), F.col("value").alias(item))


def text(value: Column | str, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def number(value: Column | str, path: str) -> Column:
    return F.try_variant_get(value, path, "double")


def strings(value: Column | str, path: str) -> Column:
    return F.try_variant_get(value, path, "array<string>")


def stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]*?)(\.[^./]*)?$", 1)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names and contents of the files at path, computed where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.sha2(F.concat_ws("/", F.substring_index("path", "/", -1), F.sha2("content", 256)), 256).alias("h"))
    parts = F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")
    got = files.agg(F.count("*"), F.sum(parts)).first()
    return f"{got[0]}-{got[1]}"
