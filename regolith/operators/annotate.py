"""Annotations of entities: from their sources, from ranked matches with evidence, from members of value sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions import infer

#: Broader terms that are added to a primary one at most.
BROADER = 3
ANNOTATION = "struct<term_uri:string,term_label:string,ontology:string,mapping_relation:string,match_level:string,score:double,model:string,primary:boolean>"


def annotation(uri: Column, label: Column, relation: Column, level: str, score: Column, model: str, primary: Column) -> Column:
    return F.struct(
        uri.alias("term_uri"), label.alias("term_label"), infer.ontology_prefix(uri).alias("ontology"), relation.alias("mapping_relation"), F.lit(level).alias("match_level"),
        score.alias("score"), F.lit(model).alias("model"), primary.alias("primary"),
    ).cast(ANNOTATION)


def from_source(name: Column, description: Column, ontology_id: Column, values: bool = False) -> Column:
    """Annotations that the source itself gives: its ontology identifier, else the first OBO URI of the description, as an exact match; null for none."""
    uri = F.coalesce(F.nullif(ontology_id, F.lit("")), infer.obo_uri(F.coalesce(description, F.lit(""))))
    own = annotation(uri, F.coalesce(name, F.lit("")), F.lit("skos:exactMatch"), "element_match" if values else "concept_match", F.lit(1.0), "source_metadata", F.lit(True))
    return F.when(uri.isNotNull(), F.array(own))


def assigned(ranked: DataFrame, terms: DataFrame, ancestors: DataFrame | None = None, model: str = "hashed") -> DataFrame:
    """(query, annotations, evidence): accepted matches in their order, the first one primary, with what speaks for each.

    ranked: (query, text, item, score, relation, position), as the gap cutoff leaves it; terms: (uri, label, definition);
    ancestors: (node, ancestor, depth), of which the nearest BROADER with a label follow as broad matches of score 0.
    """
    named = ranked.join(terms.select(F.col("uri").alias("item"), "label", "definition"), "item", "left")
    score = F.round("score", 4)
    reason = F.concat(
        F.lit("Cosine similarity "), F.format_number("score", 3), F.lit(" between '"), F.substring("text", 1, 80), F.lit("' and term '"), F.coalesce("label", F.lit("")), F.lit("'"),
        F.coalesce(F.concat(F.lit(" ("), F.substring("definition", 1, 120), F.lit(")")), F.lit("")), F.lit(". Relation: "), F.col("relation"), F.lit("."),
    )
    evidence = F.struct(
        score.alias("similarity_score"), F.lit("cosine_embedding").alias("similarity_method"), F.substring("text", 1, 500).alias("source_text"), F.col("item").alias("target_term_uri"),
        F.col("label").alias("target_term_label"), F.substring("definition", 1, 500).alias("target_term_definition"), reason.alias("reasoning"),
    )
    own = annotation(F.col("item"), F.coalesce("label", F.lit("")), F.col("relation"), "concept_match", score, model, F.col("position") == 1)
    rows = named.select("query", F.lit(False).alias("broad"), F.col("position").alias("at"), own.alias("a"), evidence.alias("e"))
    if ancestors is not None:
        first = ranked.filter("position = 1").select("query", F.col("item").alias("node"))
        up = first.join(ancestors, "node").join(terms.select(F.col("uri").alias("ancestor"), "label"), "ancestor").filter("label <> ''")
        near = up.groupBy("query").agg(F.slice(F.array_sort(F.collect_set(F.struct("depth", "ancestor", "label"))), 1, BROADER).alias("near"))
        each = near.select("query", F.posexplode("near").alias("at", "b"))
        wide = annotation(F.col("b.ancestor"), F.col("b.label"), F.lit("skos:broadMatch"), "concept_match", F.lit(0.0), "hierarchy", F.lit(False))
        rows = rows.unionByName(each.select("query", F.lit(True).alias("broad"), "at", wide.alias("a")), allowMissingColumns=True)
    got = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("broad", "at", "a", "e"))).alias("rows"))  # broader terms after all matches, however many
    return got.select("query", F.transform("rows", lambda r: r["a"]).alias("annotations"), F.filter(F.transform("rows", lambda r: r["e"]), lambda e: e.isNotNull()).alias("evidence"))


def best_of_members(sets: DataFrame, annotated: DataFrame) -> DataFrame:
    """(id, best): for value sets the member annotation of the highest score over 0, the first in member order of equal ones, as a related match.

    sets: (id, members); annotated: (name, term_uri, term_label, score).
    """
    each = sets.select("id", F.posexplode("members").alias("at", "name")).join(annotated, "name").filter("score > 0")
    best = each.groupBy("id").agg(F.max_by(F.struct("term_uri", "term_label", "score"), F.struct("score", -F.col("at"), "term_uri")).alias("b"))
    return best.select("id", annotation(F.col("b.term_uri"), F.col("b.term_label"), F.lit("skos:relatedMatch"), "concept_match", F.round("b.score", 4), "members", F.lit(True)).alias("best"))


def relevant(terms: DataFrame, taxa: list[str], column: str = "uri") -> DataFrame:
    """terms without taxa that are not listed; terms of other ontologies all stay. The list is a literal set of the caller."""
    mark = "NCBITaxon_"
    return terms.filter(~F.contains(F.col(column), F.lit(mark)) | F.substring_index(F.col(column), mark, -1).isin(*taxa) if taxa else ~F.contains(F.col(column), F.lit(mark)))


def provenance_diff(provenance: Column) -> Column:
    """array<struct<field, source_a, value_a, source_b, value_b>>: where the first two provenance entries differ; empty for fewer than two."""
    a, b = F.get(provenance, F.lit(0)), F.get(provenance, F.lit(1))
    each = F.array(*(
        F.when(~a[f].eqNullSafe(b[f]), F.struct(F.lit(f).alias("field"), a["source"].alias("source_a"), a[f].cast("string").alias("value_a"), b["source"].alias("source_b"), b[f].cast("string").alias("value_b")))
        for f in ("name", "description", "required", "multivalued")
    ))
    return F.when(F.size(provenance) >= 2, F.filter(each, lambda d: d.isNotNull())).otherwise(F.slice(each, 1, 0))


def derived_name(kind: Column, label: Column, name: Column, provenance: Column) -> Column:
    """A readable name: a value's label, a value set's name, else the first provenance entry's name."""
    return (
        F.when(kind == "values", F.coalesce(label, F.lit("value")))
        .when(kind == "valuesets", F.coalesce(name, F.lit("valueset")))
        .otherwise(F.coalesce(F.get(provenance, F.lit(0))["name"], F.lit("unknown")))
    )
