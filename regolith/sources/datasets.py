"""BIDS datasets as OpenNeuro keeps them: columns of their tables, described by sidecars, and fields of their JSON files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dictionaries import SKIPPED, shapes, value_kind
from .documents import each, entities, number, text, union

# Where a dataset's tables and JSON files are looked for, keys that make a value a column's description,
# and files that describe the dataset or are read with their table.
TABLES = r"^([^/]+\.(tsv|csv)|phenotype/[^/]+\.csv|phenotype/.+\.tsv|derivatives/.+\.(tsv|csv))$"
FIELDS = r"^(phenotype/)?[^/]+\.json$"
DESCRIBING = ("Description", "Levels", "TermURL", "Units")
NOT_FIELDS = ("dataset_description.json", "participants.json")


def _files(spark: SparkSession, root: str, kinds: str, wanted: str) -> DataFrame:
    """file, rel (path inside the dataset), text of the files wanted; others are pruned before they are opened."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", kinds).text(root, wholetext=True)
    rel = F.regexp_extract("_metadata.file_path", re.escape(root) + "/(.*)$", 1)
    return whole.filter(rel.rlike(wanted)).select(F.col("_metadata.file_path").alias("file"), rel.alias("rel"), F.col("value").alias("text"))


def _cells(line: Column, comma: Column) -> Column:
    """Cells of a line; those of a comma table may be quoted."""
    quoted = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    bare = F.transform(quoted, lambda c: F.replace(F.regexp_replace(c, r'^\s*"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"')))
    return F.when(comma, bare).otherwise(F.split(line, "\t"))


def _columns(files: DataFrame) -> DataFrame:
    """file, rel, column, data_type, n_told, categories, from all lines of each table."""
    lines = F.split(F.regexp_replace("text", "^\ufeff|\r", ""), "\n")
    own = files.select("file", "rel", F.col("rel").endswith(".csv").alias("comma"), lines.alias("lines"))
    own = own.select("file", "rel", "comma", _cells(F.get("lines", F.lit(0)), F.col("comma")).alias("names"), F.slice("lines", 2, 2**31 - 1).alias("lines"))
    rows = own.select("file", "rel", "names", "comma", F.explode(F.filter("lines", lambda x: x != "")).alias("line"))
    cells = rows.select("file", "rel", F.explode(F.arrays_zip("names", _cells(F.col("line"), F.col("comma")).alias("values"))).alias("x"))
    told = cells.select("file", "rel", F.col("x.names").alias("column"), F.col("x.values").alias("value"))
    heads = own.select("file", "rel", F.explode("names").alias("column"), F.lit(None).cast("string").alias("value"))  # of tables without rows
    return shapes(told.unionByName(heads).filter("column <> ''"), ["file", "rel", "column"])


def _describes(value: Column) -> Column:
    told = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.arrays_overlap(told, F.array(*map(F.lit, DESCRIBING))), F.lit(False))


def _descriptions(sides: DataFrame) -> DataFrame:
    """of, column, meta: what sidecars say about columns; participants.json may hold descriptions in groups, which its own keys precede."""
    own = each(sides.select(F.regexp_replace("rel", r"\.json$", "").alias("of"), "doc"), F.col("doc"), "column", "meta").filter("column is not null")
    groups = own.filter((F.col("of") == "participants") & ~_describes(F.col("meta"))).select("of", F.col("meta").alias("group"))
    inner = each(groups, F.col("group"), "column", "meta").filter("column is not null").filter(_describes(F.col("meta")))
    both = own.select("of", "column", "meta", F.lit(0).alias("no")).unionByName(inner.select("of", "column", "meta", F.lit(1).alias("no")))
    # variants do not order, so the choice is made on their text
    best = both.groupBy("of", "column").agg(F.min(F.struct("no", F.to_json("meta").alias("meta"))).alias("m"))
    return best.select("of", "column", F.parse_json("m.meta").alias("meta"))


def openneuro(spark: SparkSession, path: str) -> DataFrame:
    """Attributes, values and value sets of a dataset: columns of its tables, and fields of its JSON files.

    A column's type and categories come from all rows of its table; its sidecar gives description, unit, bounds and levels,
    and levels precede categories. Columns of one name in one table are one. A file is a row while it is cut into lines,
    so that a table has to fit in a task. Malformed JSON files and tables without a header give nothing.
    """
    root = path.rstrip("/")
    source = "openneuro/" + root.rsplit("/", 1)[-1]
    sides = _files(spark, root, "*.json", r"\.json$").select("file", "rel", F.try_parse_json("text").alias("doc")).filter("doc is not null")
    found = _columns(_files(spark, root, "*.{tsv,csv}", TABLES)).withColumn("of", F.regexp_replace("rel", r"\.[^./]*$", ""))
    rows = found.join(_descriptions(sides), ["of", "column"], "left")
    levels = F.try_variant_get("meta", "$.Levels", "map<string,variant>")
    rows = rows.withColumn("levels", F.when(F.size(levels) > 0, F.transform_values(levels, lambda k, v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), k))))
    rows = rows.withColumn("options", F.coalesce(F.array_sort(F.map_keys("levels")), "categories"))

    def first(get, *keys):
        return F.coalesce(*(get("meta", f"$.{k}") for k in keys))

    table = {"class": F.col("rel")}
    columns = entities(
        rows, entity_type="attribute", source=source, **table, name=F.col("column"), description=F.nullif(first(text, "Description", "description"), F.lit("")), data_type=F.col("data_type"),
        unit=F.nullif(first(text, "Units", "units"), F.lit("")), min_value=first(number, "MinValue", "Minimum", "minimum"), max_value=first(number, "MaxValue", "Maximum", "maximum"),
        options=F.col("options"), confidence=0.8, file=F.col("file"),
    )
    coded = rows.filter("size(options) > 1")
    sets = entities(coded, entity_type="valueset", source=source, **table, name=F.concat("column", F.lit("_values")), description=F.concat(F.lit("Values for "), "column"), members=F.col("options"), confidence=0.8, file=F.col("file"))
    each_value = coded.select("file", "rel", "column", "levels", F.explode("options").alias("option"))
    label = F.coalesce(F.element_at("levels", F.col("option")), F.col("option"))
    values = entities(each_value, entity_type="enum_value", source=source, **table, name=F.concat_ws(":", "column", "option"), description=label, confidence=0.8, file=F.col("file"))

    told = each(sides.filter(F.col("rel").rlike(FIELDS) & ~F.col("rel").isin(*NOT_FIELDS)), F.col("doc"), "key_name", "v").filter("key_name is not null")
    told = told.filter(~F.col("key_name").isin(*SKIPPED) & ~F.col("key_name").startswith("dcmmeta_") & ~_describes(F.col("v"))).withColumn("kind", value_kind(F.col("v")))
    unit = F.when(F.col("kind").isin("integer", "float", "boolean"), F.when(F.col("key_name").rlike("[Tt]ime"), "s").when(F.col("key_name").contains("Strength"), "T"))
    said = F.concat(F.lit("BIDS metadata field: "), "key_name", F.lit(" = "), F.coalesce(text("v", "$"), F.to_json("v")))
    fields = entities(told, entity_type="attribute", source=source, **table, name=F.col("key_name"), description=said, data_type=F.col("kind"), unit=unit, confidence=0.7, file=F.col("file"))
    return union([columns, values, sets, fields])
