"""Ontology files: OBO stanzas and RDF, as term and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.infer import curie_to_uri

from . import rdf

LABEL, PARENT, DEPRECATED = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "http://www.w3.org/2002/07/owl#deprecated"
SYNONYM = "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym"


def obo(spark: SparkSession, path: str, ontology: str) -> DataFrame:
    """uri, ontology, label, synonyms, deprecated, namespace, parents of each term stanza.

    Spark splits the file at line starts with a bracket, so stanzas are records and files are splittable.
    """
    stanzas = spark.read.text(path, lineSep="\n[").filter(F.col("value").rlike(r"^\[?Term\]"))
    lines = F.split("value", "\r?\n")

    def tagged(tag):
        return F.transform(F.filter(lines, lambda x: x.startswith(tag + ": ")), lambda x: F.trim(F.substring(x, len(tag) + 3, 2**31 - 1)))

    parents = F.filter(F.transform(tagged("is_a"), lambda p: curie_to_uri(F.trim(F.substring_index(p, "!", 1)))), lambda p: p.startswith("http"))
    synonyms = F.filter(F.transform(tagged("synonym"), lambda s: F.regexp_extract(s, r'^"([^"]*)"', 1)), lambda s: s != "")
    return stanzas.select(
        curie_to_uri(F.get(tagged("id"), F.lit(0))).alias("uri"), F.lit(ontology).alias("ontology"), F.get(tagged("name"), F.lit(0)).alias("label"),
        synonyms.alias("synonyms"), F.exists(tagged("is_obsolete"), lambda x: x == "true").alias("deprecated"), F.get(tagged("namespace"), F.lit(0)).alias("namespace"), parents.alias("parents"),
    ).filter("uri is not null")


def edges(terms: DataFrame) -> DataFrame:
    return terms.select(F.col("uri").alias("child"), F.explode("parents").alias("parent"), "ontology").distinct()


def terms(triples: DataFrame, ontology: str) -> DataFrame:
    """The same columns from triples (s, p, o, kind), whatever file they come from: one row a subject that has a label, synonym, parent or mark."""
    known = triples.filter((F.col("kind") != "malformed") & F.col("p").isin(LABEL, PARENT, DEPRECATED, SYNONYM))
    picked = known.groupBy(F.col("s").alias("uri")).agg(
        F.min(F.when(F.col("p") == LABEL, F.col("o"))).alias("label"),
        F.array_sort(F.collect_set(F.when(F.col("p") == SYNONYM, F.col("o")))).alias("synonyms"),
        F.coalesce(F.bool_or(F.when(F.col("p") == DEPRECATED, F.col("o").isin("true", "1"))), F.lit(False)).alias("deprecated"),
        F.array_sort(F.collect_set(F.when((F.col("p") == PARENT) & (F.col("kind") == "iri"), F.col("o")))).alias("parents"),
    )
    return picked.select("uri", F.lit(ontology).alias("ontology"), "label", "synonyms", "deprecated", F.lit(None).cast("string").alias("namespace"), "parents")


def rdf_terms(spark: SparkSession, path: str, ontology: str, form: str | None = None) -> DataFrame:
    """The same columns from Turtle, N-Triples or N-Quads."""
    return terms(rdf.triples(spark, path, form), ontology)


def n_triples(spark: SparkSession, path: str, ontology: str) -> DataFrame:
    """The same columns from N-Triples, a line a triple."""
    return rdf_terms(spark, path, ontology, "nt")
