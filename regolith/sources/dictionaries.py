"""Data dictionaries and tables: CSV and TSV dictionaries, NDA structures, profiles of data files and their sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regolith.functions import parse
from regolith.functions.infer import value_domain

from .documents import each, entities, json_files, stem, text

# Column names tried for each role, regardless of case.
ROLES = {
    "name": ("variable_name", "name", "field_name", "variable"),
    "type": ("field_type", "type", "data_type", "dtype"),
    "description": ("field_label", "description", "label", "desc"),
    "values": ("select_choices", "allowed_values", "choices", "values", "enum"),
}
# Keys of sidecars that describe the dataset and no element; units by the end of a key.
SKIPPED = ("Name", "BIDSVersion", "License", "Authors", "Acknowledgements", "HowToAcknowledge", "Funding", "ReferencesAndLinks", "DatasetDOI", "GeneratedBy", "SourceDatasets")
KEY_UNITS = (("Time", "s"), ("Strength", "T"))


def find_column(headers: list[str], role: str, preferred: str | None = None) -> str | None:
    by_lower = {h.lower(): h for h in headers}
    for name in ((preferred,) if preferred else ()) + ROLES[role]:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    return None


def csv_dictionary(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    """One attribute for each row with a name of a CSV or TSV dictionary; columns give preferred names by role."""
    sep = "\t" if path.endswith(".tsv") else ","
    rows = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    found = {r: find_column(rows.columns, r, columns.get(r)) for r in ROLES}
    if not found["name"]:
        return entities(rows.limit(0))

    def cell(role):
        return F.trim(F.coalesce(F.col(f"`{found[role]}`"), F.lit(""))) if found[role] else F.lit("")

    own = rows.select(F.input_file_name().alias("file"), *(cell(r).alias(r) for r in ROLES)).filter("name <> ''")
    options = F.when(F.col("values") != "", parse.choices(F.col("values")))
    return entities(own, entity_type="attribute", source="csv", **{"class": stem(F.col("file"))}, name=F.col("name"), description=F.nullif("description", F.lit("")), data_type=parse.keyword_type(F.col("type")), options=options, confidence=0.85, file=F.col("file"))


def profile(rows: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """column, data_type, n_told, categories of a table of strings: one pass, all rows.

    Columns are turned into (column, value) rows, so that a table of any width is one aggregation; distinct values are
    listed only for columns that have CATEGORIES or fewer.
    """
    names = [c for c in rows.columns if c not in ignore]
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names))).alias("x")).select("x.*")
    return shapes(long, ["column"])


def shapes(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, data_type, n_told, categories of cells (by, value), a column of a table for each by."""
    value = F.col("value")
    shape = cells.groupBy(*by).agg(parse.column_type(value).alias("data_type"), F.count(F.when(parse.told(value), 1)).alias("n_told"))
    distinct = cells.filter(parse.told(value)).groupBy(*by, "value").agg(F.count("*").alias("n"))
    few = distinct.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("value"))).filter(F.col("no") <= parse.CATEGORIES + 1)
    lists = few.groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("seen"))
    both = shape.join(lists, by, "left")
    return both.select(*by, "data_type", "n_told", F.when((F.col("data_type") == "string") & F.size("seen").between(2, parse.CATEGORIES), F.col("seen")).alias("categories"))


def value_kind(v: Column) -> Column:
    """Data type of a JSON value."""
    shape = F.schema_of_variant(v)
    numeric = F.when(shape == "BOOLEAN", "boolean").when(shape == "BIGINT", "integer").when(shape.startswith("DECIMAL") | (shape == "DOUBLE"), "float")
    return numeric.when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("string")


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One element for each key of JSON sidecars: type by value, unit by the key's end, description and levels if told."""
    keys = each(json_files(spark, path), F.col("doc"), "key_name", "v").filter(~F.col("key_name").isin(*SKIPPED))
    kind = value_kind(F.col("v"))
    unit = F.coalesce(text("v", "$.Units"), *(F.when(F.col("key_name").endswith(k), u) for k, u in KEY_UNITS))
    levels = F.map_keys(F.try_variant_get("v", "$.Levels", "map<string,variant>"))
    described = text("v", "$.Description").isNotNull() | levels.isNotNull()
    return entities(keys, entity_type="attribute", source="sidecar", **{"class": stem(F.col("file"))}, name=F.col("key_name"), description=text("v", "$.Description"), data_type=F.when(described, "string").otherwise(kind), unit=unit, options=F.array_sort(levels), confidence=0.8, file=F.col("file"))


NDA = "struct<shortName:string,title:string,dataElements:array<struct<name:string,description:string,type:string,valueRange:string,notes:string,required:string,size:string>>>"


def nda_structures(spark: SparkSession, path: str) -> DataFrame:
    """One attribute for each element of NDA structure files, with `class` the structure's short name."""
    docs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", NDA).alias("s"))
    rows = docs.select("file", F.coalesce("s.shortName", stem(F.col("file"))).alias("structure"), F.explode("s.dataElements").alias("e")).filter("e.name <> ''")
    least, most = parse.value_range(F.col("e.valueRange"))
    options = F.transform(parse.notes(F.col("e.notes")), lambda o: o["value"])
    return entities(rows, entity_type="attribute", source="nda", **{"class": F.col("structure")}, name=F.col("e.name"), description=F.col("e.description"), data_type=parse.nda_type(F.col("e.type")), min_value=least, max_value=most, options=F.when(F.size(options) > 0, options), confidence=0.9, file=F.col("file"))


def nda_dedup(attributes: DataFrame) -> DataFrame:
    """One row for each (name, data_type): the first structure's, with alias_hints naming all structures."""
    row = F.struct(*attributes.columns)
    hints = F.array_sort(F.collect_set(F.concat(F.lit("nda:"), "class")))
    return attributes.groupBy("name", "data_type").agg(F.min_by(row, F.struct("class", "file")).alias("r"), hints.alias("alias_hints")).select("r.*", "alias_hints")


def with_domain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value_domain", value_domain(F.col("data_type"), F.size("options") > 0))
