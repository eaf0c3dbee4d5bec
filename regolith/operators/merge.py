"""Content-addressed merge, upsert, and the derived groupings of ingestion.

Tables are DataFrames of the registry envelope: sha256, and what the entity carries. Provenance is an array of structs
with source and name, and merges on (source, name) in the order of first sight. Order is never that of rows in a
file: callers give an ordering column, and ties fall back on the entry itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_entries(rows: DataFrame, order: str) -> DataFrame:
    """(sha256, order, entry): the first entry of each (sha256, source, name); shrinks hot hashes before they meet."""
    entries = rows.select("sha256", F.col(order).alias("order"), F.posexplode_outer("provenance").alias("at", "entry"))
    first = F.min(F.struct("order", "at", "entry")).alias("f")
    return entries.groupBy("sha256", "entry.source", "entry.name").agg(first).select("sha256", "f")


def merge_by_hash(rows: DataFrame, order: str = "ord") -> DataFrame:
    """sha256, provenance, n_rows: rows of one hash collapse, their provenance is united.

    Aggregates first by (hash, source, name), so a hash with a third of all rows is summed up map-side, and only its
    distinct entries are gathered.
    """
    united = distinct_entries(rows, order).groupBy("sha256").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    counts = rows.groupBy("sha256").agg(F.count("*").alias("n_rows"))
    merged = united.select("sha256", F.filter(F.transform("fs", lambda f: f["entry"]), lambda e: e.isNotNull()).alias("provenance"))
    return merged.join(counts, "sha256")


def upsert(stored: DataFrame, fresh: DataFrame, version: str = "version", merge: bool = True) -> DataFrame:
    """stored updated by fresh on sha256, both with provenance and an ordering column.

    The newest row gives the other columns; provenance is merged, or replaced with merge = False. Rows without a hash
    are always appended.
    """
    both = stored.unionByName(fresh, allowMissingColumns=True)
    hashed = both.filter("sha256 is not null and sha256 <> ''")
    others = [c for c in both.columns if c not in ("sha256", "provenance")]
    whole = F.struct(F.col(version), *(F.col(c) for c in others if c != version), *([] if merge else ["provenance"]))
    # maps have no order; where there are some, rows of one version go by their JSON
    orderable = not any("map<" in both.schema[c].dataType.simpleString() for c in both.columns)
    newest = (F.max(whole) if orderable else F.max_by(whole, F.struct(F.col(version), F.to_json(whole)))).alias("new")
    latest = hashed.groupBy("sha256").agg(newest)
    if merge:
        united = merge_by_hash(hashed, version).select("sha256", "provenance")
        done = latest.join(united, "sha256").select("sha256", *(F.col(f"new.{c}").alias(c) for c in others), "provenance")
    else:
        done = latest.select("sha256", *(F.col(f"new.{c}").alias(c) for c in others), F.col("new.provenance").alias("provenance"))
    return done.unionByName(both.filter("sha256 is null or sha256 = ''"))


def update(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """stored with changes (sha256, key, value) applied: keys embedding, provenance and ontology_annotations name columns, all others fields of semantic.

    Values are JSON; semantic is a map of JSON values. Rows without a change are not rewritten but passed on. Of several changes of
    one key the greatest value counts.
    """
    each = changes.groupBy("sha256", "key").agg(F.max("value").alias("value"))
    packed = each.groupBy("sha256").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("_c"))
    both = stored.join(packed, "sha256", "left")
    own = [c for c in ("embedding", "provenance", "ontology_annotations") if c in stored.columns]
    for c in own:
        told = F.element_at("_c", c)
        both = both.withColumn(c, F.when(told.isNotNull(), F.from_json(told, stored.schema[c].dataType.simpleString())).otherwise(F.col(c)))
    rest = F.map_filter("_c", lambda k, _: ~k.isin("embedding", "provenance", "ontology_annotations"))
    kept = F.map_filter("semantic", lambda k, _: ~F.map_contains_key(rest, k))
    return both.withColumn("semantic", F.when(F.col("_c").isNotNull(), F.map_concat(kept, rest)).otherwise(F.col("semantic"))).drop("_c")


def imported(stored: dict[str, DataFrame], fresh: dict[str, DataFrame], clear: bool = False) -> dict[str, DataFrame]:
    """A registry's tables after an import: entities (by kind) are upserted, transforms, flags and runs inserted if absent.

    Tables of the registry that the import lacks stay, unless it clears. Keys: sha256; (entity_ref, flag_type) for flags; run_id for runs.
    """
    keys = {"transforms": ["sha256"], "flags": ["entity_ref", "flag_type"], "runs": ["run_id"]}
    out = {} if clear else dict(stored)
    for name, rows in fresh.items():
        if name not in out:
            out[name] = keep_first(rows, keys[name], []) if name in keys else upsert(rows.limit(0), rows)
        elif name in keys:
            out[name] = out[name].unionByName(insert_absent(out[name], rows, keys[name]), allowMissingColumns=True)
        else:
            out[name] = upsert(out[name], rows)
    return out


def delete(stored: DataFrame, hashes: DataFrame) -> DataFrame:
    return stored.join(hashes.select("sha256"), "sha256", "left_anti")


def insert_absent(stored: DataFrame, fresh: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Rows of fresh whose keys stored does not have, of each key the first in the order of some columns, then of the contents."""
    return keep_first(fresh, keys, list(order)).join(stored.select(*keys), keys, "left_anti")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order of some columns (nulls last), then of the rows' own contents.

    So the same rows give the same result however they are dealt or sorted; it is a plain aggregation, combined before the shuffle.
    """
    whole = F.struct(*(F.col(c) for c in rows.columns))
    place = F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c))), F.to_json(whole))
    kept = rows.groupBy(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys))).agg(F.min_by(whole, place).alias("_row"))
    return kept.select(*(F.col("_row")[c].alias(c) for c in rows.columns))


def value_label(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """Label of a raw value: a mapped alias, else lower case with underscores."""
    plain = F.replace(F.lower(raw), F.lit(" "), F.lit("_"))
    if not aliases:
        return plain
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(raw)), plain)


def value_concepts(values: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """sha256, label, raw_values of (raw) rows: values with one label are one concept."""
    labelled = values.select("raw", value_label(F.col("raw"), aliases).alias("label")).distinct()
    concepts = labelled.groupBy("label").agg(F.array_sort(F.collect_set("raw")).alias("raw_values"))
    content = F.to_json(F.struct(F.col("label"), F.lit("categorical").alias("value_type")))
    return concepts.select(F.sha2(content, 256).alias("sha256"), "label", "raw_values")


def schemas_by_class(provenance: DataFrame) -> DataFrame:
    """source, class, properties (sorted distinct names) of (source, class, name) rows."""
    return provenance.groupBy("source", "class").agg(F.array_sort(F.collect_set("name")).alias("properties"))


def multi_source(rows: DataFrame) -> DataFrame:
    """sha256, n_sources, sources of rows with provenance."""
    sources = F.array_sort(F.array_distinct(F.transform("provenance", lambda p: p["source"])))
    return rows.select("sha256", F.size(sources).alias("n_sources"), sources.alias("sources"))


def index_by_term(rows: DataFrame) -> DataFrame:
    """uri to its entities: the reverse index of primary terms. rows: (uri, entity_type, sha256)."""
    return rows.filter("uri is not null").groupBy("uri").agg(F.array_sort(F.collect_set(F.struct("entity_type", "sha256"))).alias("entities"))
