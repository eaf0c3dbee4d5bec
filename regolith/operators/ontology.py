"""Ontology tables: terms (uri, ontology, label, synonyms, deprecated) and edges (child, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import ancestors


def merge_terms(terms: DataFrame) -> DataFrame:
    """uri, label, synonyms: one row a term over all graphs; the longest label leads (ties by label), the others become synonyms.

    Terms that any graph calls deprecated are dropped.
    """
    own = terms.select("uri", "label", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), F.coalesce("deprecated", F.lit(False)).alias("deprecated"))
    names = own.select("uri", "deprecated", "label", F.explode_outer("synonyms").alias("synonym"))
    best = F.max_by("label", F.struct(F.length("label"), "label"))
    both = names.groupBy("uri").agg(best.alias("label"), F.collect_set("label").alias("labels"), F.collect_set("synonym").alias("others"), F.bool_or("deprecated").alias("deprecated"))
    rest = F.array_except(F.array_union("labels", "others"), F.array("label"))
    return both.filter("not deprecated and label is not null").select("uri", "label", F.array_sort(rest).alias("synonyms"))


def search(terms: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Terms whose label holds the text, regardless of case."""
    return terms.filter(F.contains(F.lower("label"), F.lit(text.lower()))).orderBy("label", "uri").limit(limit)


def lookup(terms: DataFrame, edges: DataFrame, uris: DataFrame) -> DataFrame:
    """uri, label, synonyms, deprecated, parents of each asked uri; null label where unknown."""
    parents = edges.groupBy(F.col("child").alias("uri")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    own = terms.groupBy("uri").agg(F.min("label").alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("synonyms", F.array().cast("array<string>")))))).alias("synonyms"), F.bool_or("deprecated").alias("deprecated"))
    return uris.select("uri").distinct().join(own, "uri", "left").join(parents, "uri", "left")


def term_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("ontology").agg(F.countDistinct("uri").alias("n_terms"))


def changed_versions(loaded: DataFrame, available: DataFrame) -> DataFrame:
    """(name, state) of ontologies: new, changed or same by checksum."""
    a, b = loaded.select("name", F.col("checksum").alias("_a")), available.select("name", F.col("checksum").alias("_b"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, "name", "full_outer").select("name", state.alias("state"))


def reload(terms: DataFrame, fresh: DataFrame) -> DataFrame:
    """terms with the graphs of fresh replaced."""
    return terms.join(fresh.select("ontology").distinct(), "ontology", "left_anti").unionByName(fresh)


def verify(elements: DataFrame, terms: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, term_uri, problem) of annotations: missing, deprecated, or a label unlike the element's name."""
    from regolith.functions.similarity import name_ratio

    known = terms.groupBy(F.col("uri").alias("_u")).agg(F.min("label").alias("_l"), F.bool_or("deprecated").alias("deprecated"))
    both = elements.filter("term_uri is not null").join(known, F.col("term_uri") == F.col("_u"), "left").withColumn("_r", name_ratio(F.col("name"), F.col("_l")))
    problem = F.when(F.col("_u").isNull(), "missing").when(F.col("deprecated"), "deprecated").when(F.col("_r") < least, "unlike")
    return both.select("id", "term_uri", problem.alias("problem")).filter("problem is not null")
