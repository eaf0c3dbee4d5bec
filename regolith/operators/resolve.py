"""References resolved to content hashes: properties, members, type references, options, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IS_HASH = r"^[0-9a-f]{64}$"


def lookup_table(rows: DataFrame, keys: list[str], value: str, order: str, last: bool = False) -> DataFrame:
    """One value for each key: of the first (or last) row in order, under the exact and the lower-cased name.

    keys end with the name column. First writer wins across both spellings, as the rows come.
    """
    *outer, name = keys
    spelled = rows.select(*outer, F.explode(F.array_distinct(F.array(F.col(name), F.lower(name)))).alias(name), F.col(value).alias(value), F.col(order).alias("_o"))
    pick = F.max_by if last else F.min_by
    return spelled.groupBy(*keys).agg(pick(value, "_o").alias(value))


def properties(schemas: DataFrame, elements: DataFrame) -> DataFrame:
    """schema_id, properties: each property as the hash of its element where one is known.

    schemas: (schema_id, class, properties). elements: (class, name, sha256, ord), one row for each provenance entry.
    In order: same class and name, same class and lower-cased name, name, lower-cased name, the property itself.
    Hashes pass through. Later elements win within a class, earlier ones across classes.
    """
    named = elements.filter("name is not null and name <> ''")
    within = lookup_table(named.filter("class is not null and class <> ''"), ["class", "name"], "sha256", "ord", last=True)
    across = lookup_table(named, ["name"], "sha256", "ord")
    each = schemas.select("schema_id", "class", F.posexplode_outer("properties").alias("at", "property"))
    low = F.lower("property")
    out = each
    for tag, table, on in (
        ("a", within, F.col("property")),
        ("b", within, low),
        ("c", across, F.col("property")),
        ("d", across, low),
    ):
        by_class = table is within
        t = table.select(*([F.col("class").alias("_k")] if by_class else []), F.col("name").alias("_n"), F.col("sha256").alias(f"_{tag}"))
        match = (on == F.col("_n")) & ((F.col("class") == F.col("_k")) if by_class else F.lit(True))
        out = out.join(t, match, "left").drop("_k", "_n")
    done = F.when(F.col("property").rlike(IS_HASH), F.col("property")).otherwise(F.coalesce("_a", "_b", "_c", "_d", "property"))
    again = out.select("schema_id", "at", done.alias("ref")).groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("at", "ref"))).alias("refs"))
    return again.select("schema_id", F.filter(F.transform("refs", lambda r: r["ref"]), lambda r: r.isNotNull()).alias("properties"))


def by_name(refs: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """refs with `resolved`: the hash that names (name, sha256) has for a reference, exact before lower-cased, else the reference."""
    exact = names.select(F.col("name").alias("_n"), F.col("sha256").alias("_x"))
    low = names.select(F.col("name").alias("_m"), F.col("sha256").alias("_y"))
    both = refs.join(exact, F.col(column) == F.col("_n"), "left").join(low, F.lower(column) == F.col("_m"), "left")
    kept = F.when(F.col(column).rlike(IS_HASH), F.col(column)).otherwise(F.coalesce("_x", "_y", column))
    return both.withColumn("resolved", kept).drop("_n", "_x", "_m", "_y")


def options(rows: DataFrame, values: DataFrame) -> DataFrame:
    """(id, at, value, label, term): response options with the URI of their value concept, by value, else by label.

    rows: (id, options array<struct<value,label>>). values: (name lower-cased, uri). Values that are URLs stay without.
    """
    each = rows.select("id", F.posexplode("options").alias("at", "o")).select("id", "at", "o.value", "o.label")
    a = values.select(F.col("name").alias("_n"), F.col("uri").alias("_x"))
    b = values.select(F.col("name").alias("_m"), F.col("uri").alias("_y"))
    both = each.join(a, F.lower("value") == F.col("_n"), "left").join(b, F.lower("label") == F.col("_m"), "left")
    term = F.when(~F.col("value").startswith("https://"), F.coalesce("_x", "_y"))
    return both.select("id", "at", "value", "label", term.alias("term"))


def member_annotations(sets: DataFrame, annotated: DataFrame, most: int = 5) -> DataFrame:
    """(id, annotations): of the members in list order, the first `most`. sets: (id, members); annotated: (name, annotations)."""
    each = sets.select("id", F.posexplode("members").alias("at", "name")).join(annotated, "name")
    got = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "annotations"))).alias("all"))
    return got.select("id", F.slice(F.flatten(F.transform("all", lambda x: x["annotations"])), 1, most).alias("annotations"))


def flag_refs(flags: DataFrame, names: DataFrame) -> DataFrame:
    """Flags whose entity_ref is a staging or file name get the hash that names (name, sha256) has for it."""
    known = names.groupBy(F.col("name").alias("_n")).agg(F.max("sha256").alias("_s"))
    return flags.join(known, F.col("entity_ref") == F.col("_n"), "left").withColumn("entity_ref", F.coalesce("_s", "entity_ref")).drop("_n", "_s")
