"""JSON Schema files: definitions as classes, value sets and values; properties as attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import each, entities, json_files, number, stem, strings, text, union

# JSON Schema types and value patterns of its formats.
TYPES = {"string": "string", "integer": "integer", "number": "float", "boolean": "boolean", "array": "array", "object": "object"}
FORMATS = {
    "date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "date": r"^\d{4}-\d{2}-\d{2}$", "time": r"^\d{2}:\d{2}:\d{2}",
    "email": r"^[^@]+@[^@]+\.[^@]+$", "uri": r"^https?://", "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def kind_of(definition: Column) -> Column:
    """valueset, enum_value, class or attribute, by structure, in this order."""
    alternatives = [F.try_variant_get(definition, f"$.{k}", "array<variant>") for k in ("oneOf", "anyOf")]
    literal = F.lit(False)
    for a in alternatives:
        all_literal = F.forall(a, lambda v: F.try_variant_get(v, "$.const", "string").isNotNull() | F.try_variant_get(v, "$.enum", "array<string>").isNotNull())
        literal = literal | F.coalesce((F.size(a) > 0) & all_literal, F.lit(False))
    enum, props = strings(definition, "$.enum"), F.try_variant_get(definition, "$.properties", "map<string,variant>")
    valueset = (F.coalesce(F.size(enum) > 1, F.lit(False)) & props.isNull()) | literal | F.coalesce(F.size(F.try_variant_get(definition, "$.permissible_values", "map<string,variant>")) > 0, F.lit(False))
    is_class = F.coalesce(F.size(props) > 0, F.lit(False)) | F.coalesce(F.size(strings(definition, "$.slots")) > 0, F.lit(False)) | text(definition, "$.is_a").isNotNull()
    return F.when(valueset, "valueset").when(text(definition, "$.const").isNotNull(), "enum_value").when(is_class, "class").otherwise("attribute")


def members_of(definition: Column) -> Column:
    """Values of an enum, or of alternatives with constants, sorted as strings."""
    by_const = [F.filter(F.transform(F.try_variant_get(definition, f"$.{k}", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.const", "string"), F.get(F.try_variant_get(v, "$.enum", "array<string>"), F.lit(0)))), lambda x: x.isNotNull()) for k in ("oneOf", "anyOf")]
    return F.array_sort(F.coalesce(F.filter(strings(definition, "$.enum"), lambda x: x.isNotNull()), *by_const))


def type_of(prop: Column) -> Column:
    """Data type of a property without a reference: its type, the first non-null of several, or the first alternative's."""
    several = F.get(F.filter(strings(prop, "$.type"), lambda t: t != "null"), F.lit(0))
    other = [F.get(F.filter(F.transform(F.try_variant_get(prop, f"$.{k}", "array<variant>"), lambda v: F.try_variant_get(v, "$.type", "string")), lambda t: t.isNotNull()), F.lit(0)) for k in ("anyOf", "oneOf", "allOf")]
    return F.coalesce(_mapped(F.coalesce(several, text(prop, "$.type"), *other), TYPES), F.lit("string"))


def definitions(files: DataFrame) -> DataFrame:
    """file, name, definition: the document itself and its $defs and definitions, by name once a file."""
    own = files.select("file", F.coalesce(text("doc", "$.title"), stem(F.col("file"))).alias("name"), F.col("doc").alias("definition"))
    parts = [own]
    for k in ("$['$defs']", "$.definitions"):
        inner = F.try_variant_get("doc", k, "variant")
        parts.append(each(files.select("file", "doc"), inner, "name", "definition").select("file", "name", "definition").filter("name is not null"))
    return union(parts)


def extract(spark: SparkSession, path: str, source: str = "json-schema") -> DataFrame:
    """Entities of JSON Schema files. References are joins by definition name within a file, so circles end by themselves."""
    defs = definitions(json_files(spark, path)).withColumn("kind", kind_of(F.col("definition")))
    classes = entities(defs.filter("kind = 'class'"), entity_type="class", source=source, **{"class": F.col("name")}, name=F.col("name"), description=text("definition", "$.description"), confidence=0.95, file=F.col("file"))
    sets = defs.filter("kind = 'valueset'").withColumn("members", members_of(F.col("definition")))
    valuesets = entities(sets, entity_type="valueset", source=source, name=F.col("name"), members=F.col("members"), confidence=0.9, file=F.col("file"))
    labels = sets.select("file", F.explode("members").alias("label")).unionByName(defs.filter("kind = 'enum_value'").select("file", text("definition", "$.const").alias("label")))
    values = entities(labels, entity_type="enum_value", source=source, name=F.col("label"), confidence=0.95, file=F.col("file"))
    props = each(defs.filter("kind = 'class'"), F.try_variant_get("definition", "$.properties", "variant"), "prop", "p")
    ref = F.substring_index(text("p", "$['$ref']"), "/", -1)
    targets = defs.select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("definition").alias("_d"))
    full = props.withColumn("_ref", ref).join(targets, (F.col("file") == F.col("_f")) & (F.col("_ref") == F.col("_n")), "left").withColumn("r", F.coalesce("_d", "p"))
    referred = F.coalesce(F.size(F.try_variant_get("r", "$.properties", "map<string,variant>")) > 0, F.lit(False)) & F.col("_d").isNotNull()

    def first(path, get=number):
        return F.coalesce(get("p", path), get("r", path))

    attributes = entities(
        full, entity_type="attribute", source=source, **{"class": F.col("name")}, name=F.col("prop"),
        description=F.coalesce(text("p", "$.description"), text("r", "$.description")),
        data_type=F.when(referred, "object").otherwise(type_of(F.col("r"))), type_ref=F.when(referred, F.col("_ref")),
        options=F.coalesce(strings("r", "$.enum"), strings("p", "$.enum")),
        min_value=F.coalesce(number("p", "$.minimum"), number("p", "$.exclusiveMinimum"), number("r", "$.minimum"), number("r", "$.exclusiveMinimum")),
        max_value=F.coalesce(number("p", "$.maximum"), number("p", "$.exclusiveMaximum"), number("r", "$.maximum"), number("r", "$.exclusiveMaximum")),
        pattern=F.coalesce(first("$.pattern", text), _mapped(first("$.format", text), FORMATS)), confidence=0.85, file=F.col("file"),
    )
    return union([classes, valuesets, values, attributes])


def _core(definition: Column) -> Column:
    """A property without what makes it optional: the only alternative that is not null, or the definition itself."""
    def alone(d, key, kept):
        found = F.filter(F.try_variant_get(d, key, "array<variant>"), kept)
        return F.when(F.size(found) == 1, F.get(found, F.lit(0)))

    told = alone(definition, "$.anyOf", lambda v: F.coalesce(F.try_variant_get(v, "$.type", "string") != "null", F.lit(True)))
    return F.coalesce(told, alone(definition, "$.allOf", lambda v: v.isNotNull()), definition)


def models(spark: SparkSession, path: str, source: str = "dandi") -> DataFrame:
    """Entities of JSON Schema dumps of a package's models, such as DANDI's: classes with their fields, and enumerations.

    Optional fields have the type of what they may hold, lists are multivalued and have that of their items; references go
    to any file of the dump. A model that several files define counts once, as the first file has it, and so does a field of it.
    """
    every = definitions(json_files(spark, path)).select("name", "file", F.to_json("definition").alias("text"))  # variants do not order
    defs = every.groupBy("name").agg(F.min(F.struct("file", "text")).alias("d")).select("name", "d.file", F.parse_json("d.text").alias("definition"))
    defs = defs.withColumn("kind", kind_of(F.col("definition")))
    enums = defs.filter("kind = 'valueset'").select(F.col("name").alias("_n"), members_of(F.col("definition")).alias("members"), F.lit(False).alias("is_class"), F.col("file").alias("_f"), text("definition", "$.description").alias("said"))
    props = each(defs.filter("kind = 'class'"), F.try_variant_get("definition", "$.properties", "variant"), "prop", "p")
    own = props.withColumn("core", _core(F.col("p")))
    several = F.coalesce(text("core", "$.type") == "array", F.lit(False))
    own = own.withColumn("several", several).withColumn("item", F.when(several, _core(F.try_variant_get("core", "$.items", "variant"))).otherwise(F.col("core")))
    own = own.withColumn("_ref", F.substring_index(text("item", "$['$ref']"), "/", -1))
    targets = defs.filter("kind = 'class'").select(F.col("name").alias("_n"), F.lit(None).cast("array<string>").alias("members"), F.lit(True).alias("is_class")).unionByName(enums.drop("_f", "said"))
    full = own.join(targets, F.col("_ref") == F.col("_n"), "left")
    simple = _mapped(text("item", "$.type"), TYPES)
    scalar = F.when(simple.isin("integer", "float", "boolean"), simple).otherwise("string")
    required = F.coalesce(F.array_contains(strings("definition", "$.required"), F.col("prop")), F.lit(False))
    fields = entities(
        full, entity_type="attribute", source=source, **{"class": F.col("name")}, name=F.col("prop"), description=F.coalesce(text("p", "$.description"), text("core", "$.description")),
        data_type=F.when(F.col("is_class"), "object").otherwise(scalar), type_ref=F.col("_n"), options=F.col("members"), required=required, multivalued=F.col("several"),
        pattern=F.coalesce(text("p", "$.pattern"), text("item", "$.pattern")), min_value=number("item", "$.minimum"), max_value=number("item", "$.maximum"), confidence=0.95, file=F.col("file"),
    )
    names = F.array_sort(F.map_keys(F.try_variant_get("definition", "$.properties", "map<string,variant>")))
    classes = entities(defs.filter("kind = 'class'"), entity_type="class", source=source, **{"class": F.col("name")}, name=F.col("name"), description=text("definition", "$.description"), members=names, confidence=0.95, file=F.col("file"))
    sets = entities(enums, entity_type="valueset", source=source, name=F.col("_n"), description=F.col("said"), members=F.col("members"), confidence=0.95, file=F.col("_f"))
    each_value = enums.select("_f", "_n", F.explode("members").alias("value"))
    values = entities(each_value, entity_type="enum_value", source=source, **{"class": F.col("_n")}, name=F.col("value"), confidence=0.95, file=F.col("_f"))
    return union([classes, fields, sets, values])
