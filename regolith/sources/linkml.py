"""LinkML files: classes, their attributes and slots, enums with their values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.operators.graph import materialised

from .documents import each, entities, number, stem, strings, text, union, whole_files

# Ranges that are types; other ranges are references.
RANGES = {"string": "string", "integer": "integer", "float": "float", "double": "float", "boolean": "boolean", "date": "string", "datetime": "string", "uri": "string", "uriorcurie": "string", "ncname": "string"}


@F.pandas_udf(T.StringType())
def yaml_to_json(text: pd.Series) -> pd.Series:
    """JSON of YAML texts, null for what is none."""
    import yaml

    def one(t):
        try:
            return None if t is None else json.dumps(yaml.safe_load(t), default=str)
        except yaml.YAMLError:
            return None

    return text.map(one)


def yaml_files(spark: SparkSession, path: str) -> DataFrame:
    docs = whole_files(spark, path, "*.y*ml").select("file", F.try_parse_json(yaml_to_json("text")).alias("doc"))
    return docs.filter("doc is not null")


def _range(slot: Column) -> tuple[Column, Column]:
    """Data type and type reference of a slot or attribute."""
    r = text(slot, "$.range")
    known = F.element_at(F.create_map(*(F.lit(x) for kv in RANGES.items() for x in kv)), r)
    return F.coalesce(known, F.lit("string")), F.when(r.isNotNull() & known.isNull(), r)


def _attributes(rows: DataFrame, slot: str, source: Column, cls: Column) -> DataFrame:
    s = F.col(slot)
    kind, ref = _range(s)
    unit = F.coalesce(text(s, "$.annotations.unit.value"), text(s, "$.annotations.unit"))
    return entities(
        rows, entity_type="attribute", source=source, **{"class": cls}, name=F.col("name"), description=text(s, "$.description"), data_type=kind, type_ref=ref, unit=unit,
        pattern=text(s, "$.pattern"), min_value=number(s, "$.minimum_value"), max_value=number(s, "$.maximum_value"),
        required=F.try_variant_get(s, "$.required", "boolean"), multivalued=F.try_variant_get(s, "$.multivalued", "boolean"), confidence=0.9, file=F.col("file"),
    )


def extract_docs(docs: DataFrame, source: str | None = None) -> DataFrame:
    """Entities of (file, doc) rows of LinkML schemas."""
    named = docs.withColumn("schema", F.coalesce(text("doc", "$.name"), stem(F.col("file"))))
    origin = F.lit(source) if source else F.col("schema")
    own = each(named, F.try_variant_get("doc", "$.classes", "variant"), "class_name", "c").filter("c is not null")
    inline = F.coalesce(F.map_keys(F.try_variant_get("c", "$.attributes", "map<string,variant>")), F.array().cast("array<string>"))
    slots = F.coalesce(strings("c", "$.slots"), F.array().cast("array<string>"))
    classes = entities(own, entity_type="class", source=origin, **{"class": F.col("class_name")}, name=F.col("class_name"), description=text("c", "$.description"), type_ref=text("c", "$.is_a"), members=F.concat(slots, inline), confidence=0.95, file=F.col("file"))
    attributes = each(own, F.try_variant_get("c", "$.attributes", "variant"), "name", "s").filter("s is not null")
    shared = each(named, F.try_variant_get("doc", "$.slots", "variant"), "name", "s").filter("s is not null")
    enums = each(named, F.try_variant_get("doc", "$.enums", "variant"), "enum", "e").filter("e is not null")
    permitted = F.try_variant_get("e", "$.permissible_values", "map<string,variant>")
    valuesets = entities(enums, entity_type="valueset", source=origin, **{"class": F.col("schema")}, name=F.col("enum"), description=text("e", "$.description"), members=F.coalesce(F.array_sort(F.map_keys(permitted)), F.array().cast("array<string>")), confidence=0.95, file=F.col("file"))
    listed = each(enums, F.try_variant_get("e", "$.permissible_values", "variant"), "value", "v").filter("value is not null")
    values = entities(listed, entity_type="enum_value", source=origin, **{"class": F.col("enum")}, name=F.col("value"), description=text("v", "$.description"), ontology_id=text("v", "$.meaning"), confidence=0.95, file=F.col("file"))
    return union([classes, _attributes(attributes, "s", origin, F.col("class_name")), _attributes(shared, "s", origin, F.col("schema")), valuesets, values])


def extract(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    return extract_docs(yaml_files(spark, path), source)


# --- inheritance

#: What a slot's definition may say, nearest definition first.
PROPERTIES = ("range", "description", "pattern", "minimum_value", "maximum_value", "required", "multivalued")


def parents(docs: DataFrame) -> DataFrame:
    """(schema, class, parent, place): what each class inherits from, mixins in their order (0, 1, ...) before is_a."""
    named = docs.withColumn("schema", F.coalesce(text("doc", "$.name"), stem(F.col("file"))))
    own = each(named, F.try_variant_get("doc", "$.classes", "variant"), "class_name", "c").filter("c is not null")
    mixins = F.coalesce(strings("c", "$.mixins"), F.array().cast("array<string>"))
    every = F.concat(mixins, F.filter(F.array(text("c", "$.is_a")), lambda p: p.isNotNull()))
    return own.select("schema", F.col("class_name").alias("class"), F.posexplode(every).alias("place", "parent"))


def linearised(docs: DataFrame) -> DataFrame:
    """(schema, class, ancestor, depth, path): each class with itself and all that it inherits from, once each, by the shortest way and then the first one.

    Joined to a fixpoint, a level a round; classes that inherit from each other in a circle come to an end.
    """
    up = materialised(parents(docs), "parents")
    named = docs.withColumn("schema", F.coalesce(text("doc", "$.name"), stem(F.col("file"))))
    own = each(named, F.try_variant_get("doc", "$.classes", "variant"), "class_name", "c")
    level = own.select("schema", F.col("class_name").alias("class"), F.col("class_name").alias("ancestor"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"))
    level = materialised(level, "lines")
    found = level
    while True:
        step = level.join(up.withColumnRenamed("class", "ancestor"), ["schema", "ancestor"]).select("schema", "class", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("place")).alias("path"))
        fresh = step.groupBy("schema", "class", "ancestor", "depth").agg(F.min("path").alias("path")).join(found.select("schema", "class", "ancestor"), ["schema", "class", "ancestor"], "left_anti")
        level = materialised(fresh.select(*found.columns), "lines")
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def induced(docs: DataFrame) -> DataFrame:
    """(schema, class, name, from_class, and PROPERTIES): the slots that each class has in the end.

    A class has its own attributes and slots and those of all that it inherits from. Each property of a slot comes from the nearest class that
    says it, as an attribute or a slot_usage; what none says, from the schema's slot of that name.
    """
    named = docs.withColumn("schema", F.coalesce(text("doc", "$.name"), stem(F.col("file"))))
    own = each(named, F.try_variant_get("doc", "$.classes", "variant"), "class_name", "c").filter("c is not null")

    def said(rows, cls):
        return rows.select("schema", cls.alias("ancestor"), "name", *(text("s", f"$.{p}").alias(p) for p in PROPERTIES))

    attributes = each(own, F.try_variant_get("c", "$.attributes", "variant"), "name", "s")
    usage = each(own, F.try_variant_get("c", "$.slot_usage", "variant"), "name", "s")
    listed = own.select("schema", F.col("class_name").alias("ancestor"), F.explode(F.coalesce(strings("c", "$.slots"), F.array().cast("array<string>"))).alias("name"))
    shared = each(named, F.try_variant_get("doc", "$.slots", "variant"), "name", "s").select("schema", "name", *(text("s", f"$.{p}").alias(f"_{p}") for p in PROPERTIES))
    has = attributes.select("schema", F.col("class_name").alias("ancestor"), "name").unionByName(listed).distinct()
    lines = linearised(docs)
    place = F.struct("depth", "path", "ancestor")
    owned = lines.join(has, ["schema", "ancestor"]).groupBy("schema", "class", "name").agg(F.min_by("ancestor", place).alias("from_class"))
    tells = lines.join(said(attributes, F.col("class_name")).unionByName(said(usage, F.col("class_name"))), ["schema", "ancestor"])
    nearest = tells.groupBy("schema", "class", "name").agg(*(F.min_by(F.col(p), F.when(F.col(p).isNotNull(), place)).alias(p) for p in PROPERTIES))
    full = owned.join(nearest, ["schema", "class", "name"], "left").join(shared, ["schema", "name"], "left")
    return full.select("schema", "class", "name", "from_class", *(F.coalesce(p, f"_{p}").alias(p) for p in PROPERTIES))


# --- writing


def documents(rows: DataFrame) -> DataFrame:
    """(file, text): a LinkML schema for each source of ENTITY rows, which extract_docs reads back to the same rows.

    Classes come after those that they inherit from. The text is JSON, which YAML readers take. A schema is one row of the result, with one entry for
    each of its classes, slots, enums and values.
    """
    reference = F.coalesce(F.nullif("type_ref", F.lit("")), "data_type")
    unit = F.when(F.col("unit").isNotNull(), F.struct("unit"))
    slot = F.to_json(F.struct(
        reference.alias("range"), "description", "pattern", F.col("min_value").alias("minimum_value"), F.col("max_value").alias("maximum_value"), "required", "multivalued", unit.alias("annotations")
    ))
    attributes = rows.filter("entity_type = 'attribute'").select("source", "class", "name", slot.alias("json"))

    def table(df, keys, into):
        """Entries (name, json) of each key, by name."""
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "json"))).alias(into))

    def named(entries):
        return _object(entries, lambda x: x["name"], lambda x: x["json"])

    classes = rows.filter("entity_type = 'class'").select("source", "name", "description", F.col("type_ref").alias("is_a"), "members")
    inline = table(attributes.join(classes.select("source", F.col("name").alias("class")), ["source", "class"], "left_semi"), ("source", "class"), "own").withColumnRenamed("class", "name")
    both = classes.join(inline, ["source", "name"], "left").join(_depths(classes), ["source", "name"], "left")
    others = F.array_except(F.coalesce("members", F.array().cast("array<string>")), F.coalesce(F.transform("own", lambda x: x["name"]), F.array().cast("array<string>")))
    whole = both.select("source", F.coalesce("depth", F.lit(0)).alias("depth"), "name", _fields(description=_quoted(F.col("description")), is_a=_quoted(F.col("is_a")), slots=F.when(F.size(others) > 0, F.to_json(others)), attributes=named("own")).alias("json"))
    of_classes = whole.groupBy("source").agg(named(F.array_sort(F.collect_list(F.struct("depth", "name", "json")))).alias("classes"))
    shared = table(attributes.filter(F.col("class") == F.col("source")), ("source",), "shared")
    value = rows.filter("entity_type = 'enum_value'").select("source", F.col("class").alias("enum"), "name", F.to_json(F.struct("description", F.col("ontology_id").alias("meaning"))).alias("json"))
    sets = rows.filter("entity_type = 'valueset'").select("source", "name", "description").join(table(value, ("source", "enum"), "values").withColumnRenamed("enum", "name"), ["source", "name"], "left")
    enums = table(sets.select("source", "name", _fields(description=_quoted(F.col("description")), permissible_values=named("values")).alias("json")), ("source",), "enums")
    every = rows.select("source").distinct().join(of_classes, "source", "left").join(shared, "source", "left").join(enums, "source", "left")
    doc = _fields(id=_quoted(F.concat(F.lit("https://example.org/"), "source")), name=_quoted(F.col("source")), classes=F.col("classes"), slots=named("shared"), enums=named("enums"))
    return every.select(F.concat("source", F.lit(".yaml")).alias("file"), doc.alias("text"))


def _quoted(c: Column) -> Column:
    whole = F.to_json(F.array(c))
    return F.when(c.isNotNull(), whole.substr(F.lit(2), F.length(whole) - 2))


def _fields(**values: Column) -> Column:
    """A JSON object of what is not null; values are JSON."""
    told = F.array(*(F.concat(F.lit(f'"{k}":'), v) for k, v in values.items()))
    return F.concat(F.lit("{"), F.array_join(F.filter(told, lambda p: p.isNotNull()), ","), F.lit("}"))


def _object(column: Column | str, key, value) -> Column:
    """A JSON object of an array, in its order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(column, lambda x: F.concat(_quoted(key(x)), F.lit(":"), value(x))), ","), F.lit("}"))


def _depths(classes: DataFrame) -> DataFrame:
    """(source, name, depth): how many classes a class inherits from in a line; those in a circle count as far as the others are known."""
    level = materialised(classes.select("source", "name", "is_a", F.lit(0).alias("depth"), F.array("name").alias("seen")), "depths")
    found = level.select("source", "name", "depth")
    up = classes.select("source", F.col("name").alias("is_a"), F.col("is_a").alias("next"))
    while True:
        step = level.join(up, ["source", "is_a"]).filter(~F.array_contains("seen", F.col("is_a")))
        level = materialised(step.select("source", "name", F.col("next").alias("is_a"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("is_a")).alias("seen")), "depths")
        if level.isEmpty():
            return found.groupBy("source", "name").agg(F.max("depth").alias("depth"))
        found = found.unionByName(level.select("source", "name", "depth"))
