"""Schemas of research standards, from JSON or YAML dumps: BIDS, NWB, openMINDS, AIND, ReproSchema.

Every reader opens whole files as variants and turns nested keys into rows; references between files are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import each, entities, json_files, number, stem, strings, text, union
from .json_schema import TYPES
from .linkml import yaml_files

# NWB dtypes and the type that each stands for.
NWB_DTYPES = {
    "text": "string", "utf": "string", "utf8": "string", "ascii": "string", "isodatetime": "string", "int8": "integer", "int16": "integer",
    "int32": "integer", "int64": "integer", "uint8": "integer", "uint16": "integer", "uint32": "integer", "uint64": "integer", "float16": "float",
    "float32": "float", "float64": "float", "double": "float", "bool": "boolean",
}


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _variant(value: str | Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def bids(spark: SparkSession, path: str) -> DataFrame:
    """The dumped schema: objects.metadata, columns and entities as attributes, enums as value sets, rules.sidecars as classes."""
    docs = json_files(spark, path)
    attributes = []
    for group in ("metadata", "columns", "entities"):
        rows = each(docs, _variant("doc", f"$.objects.{group}"), "key_name", "v").filter("v is not null")
        kind = F.coalesce(F.element_at(_table(TYPES), text("v", "$.type")), F.lit("string"))
        attributes.append(entities(
            rows, entity_type="attribute", source="bids", **{"class": F.lit(group)}, name=F.coalesce(text("v", "$.name"), F.col("key_name")), description=text("v", "$.description"), data_type=kind,
            unit=text("v", "$.unit"), pattern=text("v", "$.pattern"), min_value=number("v", "$.minimum"), max_value=number("v", "$.maximum"), options=strings("v", "$.enum"), confidence=0.95, file=F.col("file"),
        ))
    enums = each(docs, _variant("doc", "$.objects.enums"), "key_name", "v").filter("v is not null")
    values = entities(enums, entity_type="enum_value", source="bids", name=F.coalesce(text("v", "$.value"), F.col("key_name")), description=text("v", "$.description"), confidence=0.95, file=F.col("file"))
    coded = union(attributes).filter("size(options) > 0")
    sets = entities(coded, entity_type="valueset", source="bids", **{"class": F.col("class")}, name=F.col("name"), members=F.array_sort("options"), confidence=0.95, file=F.col("file"))
    groups = each(each(docs, _variant("doc", "$.rules.sidecars"), "family", "f"), F.col("f"), "key_name", "v").filter("v is not null")
    fields = F.array_sort(F.map_keys(F.try_variant_get("v", "$.fields", "map<string,variant>")))
    classes = entities(groups, entity_type="class", source="bids", **{"class": F.col("key_name")}, name=F.col("key_name"), members=fields, confidence=0.9, file=F.col("file"))
    return union([*attributes, values, sets, classes])


def _inner(rows: DataFrame, column: str) -> DataFrame:
    """file, v: the groups and datasets inside a variant, as rows."""
    nothing = F.array().cast("array<variant>")
    both = F.concat(*(F.coalesce(F.try_variant_get(column, f"$.{k}", "array<variant>"), nothing) for k in ("groups", "datasets")))
    return rows.select("file", F.explode(both).alias("v")).filter("v is not null")


def nwb(spark: SparkSession, path: str) -> DataFrame:
    """Namespaces in YAML: types as classes; attributes, datasets, links and groups as slots; types nested to any depth."""
    docs = yaml_files(spark, path)
    level = _inner(docs, "doc")
    found = level
    while not level.isEmpty():  # one job a level of nesting, over schema files
        level = _inner(level, "v")
        found = found.unionByName(level)
    types = found.withColumn("type_name", text("v", "$.neurodata_type_def")).filter("type_name is not null")
    classes = entities(types, entity_type="class", source="nwb", **{"class": F.col("type_name")}, name=F.col("type_name"), description=text("v", "$.doc"), type_ref=text("v", "$.neurodata_type_inc"), confidence=0.95, file=F.col("file"))
    slots = []
    for k in ("attributes", "datasets", "links", "groups"):
        rows = each(types, _variant("v", f"$.{k}"), "i", "s").filter("s is not null").withColumn("slot", F.coalesce(text("s", "$.name"), F.lower(F.coalesce(text("s", "$.neurodata_type_def"), text("s", "$.neurodata_type_inc"), text("s", "$.target_type"))))).filter("slot is not null")
        ref = F.coalesce(text("s", "$.neurodata_type_def"), text("s", "$.neurodata_type_inc"), text("s", "$.target_type"))
        kind = F.when(ref.isNotNull(), "object").otherwise(F.coalesce(F.element_at(_table(NWB_DTYPES), text("s", "$.dtype")), F.lit("string")))
        slots.append(entities(rows, entity_type="attribute", source="nwb", **{"class": F.col("type_name")}, name=F.col("slot"), description=text("s", "$.doc"), data_type=kind, type_ref=ref, required=F.coalesce(F.try_variant_get("s", "$.required", "boolean"), F.lit(True)), multivalued=text("s", "$.quantity").isin("*", "+"), confidence=0.9, file=F.col("file")))
    return union([classes, *slots])


def openminds(spark: SparkSession, path: str) -> DataFrame:
    """Schema files: short property names, linked or embedded types as references."""
    docs = json_files(spark, path).filter(_variant("doc", "$.properties").isNotNull())
    name = F.coalesce(F.substring_index(text("doc", "$._type"), "/", -1), text("doc", "$.name"), stem(F.col("file")))
    named = docs.withColumn("class_name", name)
    classes = entities(named, entity_type="class", source="openminds", **{"class": F.col("class_name")}, name=F.col("class_name"), description=text("doc", "$.description"), confidence=0.95, file=F.col("file"))
    props = each(named, _variant("doc", "$.properties"), "long_name", "p").filter("p is not null").withColumn("prop", F.substring_index("long_name", "/", -1))
    linked = F.get(F.concat(F.coalesce(strings("p", "$._linkedTypes"), F.array().cast("array<string>")), F.coalesce(strings("p", "$._embeddedTypes"), F.array().cast("array<string>"))), F.lit(0))
    ref = F.substring_index(linked, "/", -1)
    kind = F.when(ref.isNotNull(), "object").otherwise(F.coalesce(F.element_at(_table({"integer": "integer", "number": "float", "boolean": "boolean"}), text("p", "$.type")), F.lit("string")))
    required = F.array_contains(strings("doc", "$.required"), F.col("long_name"))
    attributes = entities(props, entity_type="attribute", source="openminds", **{"class": F.col("class_name")}, name=F.col("prop"), description=text("p", "$._instruction"), data_type=kind, type_ref=ref, required=required, multivalued=text("p", "$.type") == "array", confidence=0.9, file=F.col("file"))
    return union([classes, attributes])


def openminds_instances(spark: SparkSession, path: str) -> DataFrame:
    """Controlled terms as values of the value set of their type, with their ontology identifiers."""
    docs = json_files(spark, path, "*.jsonld")
    kind, name = F.substring_index(text("doc", "$['@type']"), "/", -1), text("doc", "$.name")
    term = F.coalesce(text("doc", "$.preferredOntologyIdentifier"), text("doc", "$['https://openminds.ebrains.eu/vocab/preferredOntologyIdentifier']"))
    rows = docs.select("file", kind.alias("kind"), name.alias("label"), term.alias("term"), text("doc", "$.definition").alias("about")).filter("label is not null")
    values = entities(rows, entity_type="enum_value", source="openminds", **{"class": F.col("kind")}, name=F.col("label"), description=F.col("about"), ontology_id=F.col("term"), confidence=0.95, file=F.col("file"))
    sets = rows.groupBy("kind").agg(F.array_sort(F.collect_set("label")).alias("members"))
    return union([values, entities(sets, entity_type="valueset", source="openminds", **{"class": F.col("kind")}, name=F.col("kind"), members=F.col("members"), confidence=0.95)])


def reproschema(spark: SparkSession, path: str) -> DataFrame:
    """Activities as classes and items as attributes; response options given by reference are joined in by file."""
    docs = json_files(spark, path, "*")
    folder = F.regexp_replace("file", r"[^/]*$", "")
    kind = F.lower(F.coalesce(text("doc", "$['@type']"), text("doc", "$.category"), F.lit("")))
    label = F.coalesce(text("doc", "$.prefLabel.en"), text("doc", "$['skos:prefLabel'].en"), text("doc", "$.prefLabel"), text("doc", "$.id"), stem(F.col("file")))
    rows = docs.select("file", "doc", kind.alias("kind"), label.alias("label"), F.coalesce(text("doc", "$.id"), stem(F.col("file"))).alias("id"), folder.alias("folder"))
    activities = rows.filter(F.col("kind").contains("activity"))
    classes = entities(activities, entity_type="class", source="reproschema", **{"class": F.col("id")}, name=F.col("label"), description=text("doc", "$.description.en"), members=strings("doc", "$.ui.order"), confidence=0.95, file=F.col("file"))
    items = rows.filter(F.col("kind").contains("field") | F.col("kind").contains("item"))
    given = text("doc", "$.responseOptions")
    target = F.regexp_replace(F.concat("folder", F.regexp_replace(given, r"^\./", "")), r"[^/]+/\.\./", "")
    named = items.withColumn("target", F.when(given.isNotNull() & ~given.startswith("{"), target))
    other = docs.select(F.col("file").alias("_f"), F.col("doc").alias("_d"))
    full = named.join(other, F.col("target") == F.col("_f"), "left").withColumn("r", F.coalesce("_d", _variant("doc", "$.responseOptions")))
    vt = F.lower(F.coalesce(F.get(strings("r", "$.valueType"), F.lit(0)), text("r", "$.valueType"), F.lit("")))
    choices = F.transform(F.try_variant_get("r", "$.choices", "array<variant>"), lambda c: F.coalesce(F.try_variant_get(c, "$.value", "string"), F.try_variant_get(c, "$", "string")))
    least, most = number("r", "$.minValue"), number("r", "$.maxValue")
    data_type = F.when(vt.contains("int"), "integer").when(vt.rlike("float|double|decimal"), "float").when(vt.contains("bool"), "boolean").when(F.size(choices) > 0, "string").when(least.isNotNull() | most.isNotNull(), "integer").otherwise("string")
    attributes = entities(full, entity_type="attribute", source="reproschema", **{"class": F.regexp_extract("folder", r"([^/]*)/[^/]*/$", 1)}, name=F.col("id"), description=F.coalesce(text("doc", "$.question.en"), F.col("label")), data_type=data_type, min_value=least, max_value=most, options=F.when(F.size(choices) > 0, choices), confidence=0.9, file=F.col("file"))
    return union([classes, attributes])
