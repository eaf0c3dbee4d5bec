"""The registry pipeline: stage, enrich, annotate, commit, resolve, align, transform, flag, summarise; run() takes all steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions import identity, infer, units
from regolith.operators import align, annotate, curate, merge, resolve, transforms, vectors
from regolith.operators.graph import materialised
from regolith.operators.vector_index import VectorIndex, encoded

#: What readers call the entities that become elements.
ELEMENT = "attribute"


def staged(entities: DataFrame) -> DataFrame:
    """Extracted entities without repetitions of (type, source, class, name); the first by file stays."""
    return merge.keep_first(entities, ["entity_type", "source", "class", "name"], ["file"])


def enriched(elements: DataFrame, corrected: bool = False) -> DataFrame:
    """Elements with missing units, patterns, bounds and domains inferred from what they say, and annotations that their source gives; what is there stays."""
    about = F.coalesce("description", F.lit(""))
    told = about != ""
    least, most = infer.bounds(about)
    unit = F.coalesce("unit", F.when(told, infer.unit(about, F.col("name"), corrected)))
    out = elements.withColumn("unit", unit).withColumn("pattern", F.coalesce("pattern", infer.pattern(about)))
    out = out.withColumn("min_value", F.coalesce("min_value", least)).withColumn("max_value", F.coalesce("max_value", most))
    out = out.withColumn("unit_uri", units.alias_uri(F.col("unit"))).withColumn("value_domain", infer.value_domain(F.col("data_type"), F.size("options") > 0))
    ontology_id = F.col("ontology_id") if "ontology_id" in elements.columns else F.lit(None).cast("string")
    return out.withColumn("annotations", annotate.from_source(F.col("name"), F.col("description"), ontology_id))


def committed(elements: DataFrame, known_sources: list[str] | None = None) -> DataFrame:
    """sha256, provenance, n_rows of elements, with their semantic block; rows of unknown sources are left out (unknown_source_flags tells them).

    The order of first sight is that of file, class and name; of the rows of one hash the first gives the semantic block.
    """
    if known_sources is not None:
        elements = elements.filter(F.col("source").isin(known_sources))
    elements = elements.select("*", F.arrays_zip("options", "options").cast("array<struct<value:string,label:string>>").alias("response_options"))
    semantic = F.to_json(F.struct("data_type", "unit", "unit_uri", "pattern", "min_value", "max_value", "type_ref", "response_options"))
    provenance = F.array(F.struct("source", "class", "name", "description"))
    own = elements.withColumn("provenance", provenance).select("*", semantic.alias("semantic"))
    rows = own.withColumn("sha256", identity.sha256(identity.identity_json(F.col("semantic"), F.col("provenance"), F.col("annotations"))))
    rows = rows.withColumn("ord", F.concat_ws("\u0001", F.coalesce("file", F.lit("")), "source", F.coalesce("class", F.lit("")), "name"))
    term = identity.primary_annotation(F.col("annotations"))["term_uri"]
    kept = F.struct("data_type", "unit", "value_domain", F.col("options").alias("choices"), "min_value", "max_value", term.alias("term_uri"), "annotations")
    one = rows.groupBy("sha256").agg(F.min_by(kept, "ord").alias("s")).select("sha256", "s.*")
    return merge.merge_by_hash(rows).join(one, "sha256")


def schemas_of(registry: DataFrame) -> DataFrame:
    """(schema_id, class, properties): a schema for each source and class of the committed elements."""
    found = merge.schemas_by_class(registry.select(F.explode("provenance").alias("p")).select("p.source", "p.class", "p.name").filter("class is not null"))
    return found.select(F.concat_ws("/", "source", "class").alias("schema_id"), "class", "properties")


def resolved_schemas(schemas: DataFrame, registry: DataFrame) -> DataFrame:
    """Schemas (schema_id, class, properties) with their properties as hashes of committed elements."""
    each = registry.select("sha256", F.posexplode("provenance").alias("ord", "p")).select(F.col("p.class").alias("class"), F.col("p.name").alias("name"), "sha256", F.struct("sha256", "ord").alias("ord"))
    return resolve.properties(schemas, each)


def unknown_source_flags(elements: DataFrame, known_sources: list[str]) -> DataFrame:
    """Flags for elements of sources that are not on the list, one for each source and class."""
    bad = elements.filter(~F.col("source").isin(known_sources)).select("source", "class").distinct()
    return bad.select(F.lit("elements").alias("entity_type"), F.concat_ws("/", "source", "class").alias("entity_ref"), F.lit("unknown_source").alias("flag_type"), F.lit("pending").alias("status"))


def annotated(elements: DataFrame, index: VectorIndex, terms: DataFrame, encoder: Callable[[Column], Column], threshold: float = 0.5, ancestors: DataFrame | None = None) -> DataFrame:
    """Elements of which those without an annotation of their source get those of the nearest terms, with `evidence`.

    index: terms (uri) by vectors of the same encoder; terms: (uri, label, definition). A name stands for all elements of a name and
    description, so each text is encoded and searched once.
    """
    text = infer.embedding_text(F.lit(None).cast("string"), F.col("name"), F.col("description"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = elements.withColumn("_text", text)
    asked = encoded(own.filter("annotations is null").select(F.col("_text").alias("query")).distinct(), "query", encoder)
    near = vectors.gap_cutoff(index.search(asked, vectors.TOP), threshold)
    found = annotate.assigned(near.withColumn("text", F.col("query")), terms, ancestors, index.encoder)
    both = own.join(found.select(F.col("query").alias("_text"), F.col("annotations").alias("_found"), "evidence"), "_text", "left")
    return both.withColumn("annotations", F.coalesce("annotations", "_found")).drop("_text", "_found")


def with_vectors(registry: DataFrame, encoder: Callable[[Column], Column]) -> DataFrame:
    """Committed elements with the vector of the text that stands for them."""
    first = F.col("provenance")[0]
    labels = F.transform(F.coalesce("annotations", F.array().cast(f"array<{annotate.ANNOTATION}>")), lambda a: a["term_label"])
    text = infer.embedding_text(first["class"], first["name"], first["description"], F.col("data_type"), F.col("unit"), labels, F.transform("provenance", lambda p: p["source"]))
    return encoded(registry.withColumn("_text", text), "_text", encoder).drop("_text")


def aligned(registry: DataFrame, threshold: float = 0.5, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored pairs of committed elements, and the groups of their exact matches; hints: (sha256, hints), what else says that elements belong together.

    Vectors are compared if the registry has them, else names.
    """
    vector = F.col("vector") if "vector" in registry.columns else F.lit(None).cast("array<float>")
    told = registry.join(hints, "sha256", "left") if hints is not None else registry.withColumn("hints", F.lit(None).cast("array<string>"))
    rows = told.select(F.col("sha256").alias("id"), "data_type", "term_uri", "min_value", "max_value", "choices", vector.alias("vector"), "hints", F.col("provenance")[0]["name"].alias("name"))
    pairs = materialised(align.candidates(rows, threshold), "pairs")
    return pairs, align.groups(pairs)


def edges(registry: DataFrame, similar: float = transforms.SIMILAR) -> DataFrame:
    """Transforms between committed elements: by term, by name across sources, and by vectors if the registry has them."""
    rows = registry.select(
        F.col("sha256").alias("id"), "sha256", F.col("provenance")[0]["source"].alias("source"), F.col("provenance")[0]["name"].alias("name"), "term_uri",
        "data_type", "unit", "value_domain", "choices", F.lit(None).cast("string").alias("structural_type"), *(["vector"] if "vector" in registry.columns else []),
    )
    return transforms.generate(rows, similar)


def flags(registry: DataFrame, made: DataFrame) -> DataFrame:
    """Curation flags of a run: unsure annotations and transforms of unknown kind, one of an entity and type."""
    scores = registry.select(F.col("sha256").alias("id"), F.sort_array(F.transform(F.coalesce("annotations", F.array().cast(f"array<{annotate.ANNOTATION}>")), lambda a: a["score"]), asc=False).alias("scores"))
    unsure = curate.annotation_flags(scores).select(F.lit("elements").alias("entity_type"), "entity_ref", "flag_type", F.lit("pending").alias("status"))
    return merge.keep_first(unsure.unionByName(transforms.unknown_flags(made)), ["entity_ref", "flag_type"], ["entity_type"])


@dataclass(frozen=True)
class Run:
    """What a run leaves: tables, each written down."""

    registry: DataFrame
    schemas: DataFrame
    pairs: DataFrame
    groups: DataFrame
    transforms: DataFrame
    flags: DataFrame
    summary: DataFrame


def run(
    entities: DataFrame, known_sources: list[str] | None = None, schemas: DataFrame | None = None, encoder: Callable[[Column], Column] | None = None,
    index: VectorIndex | None = None, terms: DataFrame | None = None, hints: DataFrame | None = None, threshold: float = 0.5, stored: DataFrame | None = None,
) -> Run:
    """All steps over extracted entities (ENTITY rows).

    encoder: vectors of texts, for annotation by an index of terms, alignment and transforms; without one names are compared.
    schemas: (schema_id, class, properties); by default one for each source and class of the elements. stored: flags that are there already.
    """
    elements = enriched(staged(entities.filter(F.col("entity_type") == ELEMENT)))
    if index is not None and encoder is not None and terms is not None:
        elements = annotated(elements, index, terms, encoder)
    elements = materialised(elements, "elements")
    registry = committed(elements, known_sources)
    registry = materialised(with_vectors(registry, encoder) if encoder is not None else registry, "registry")
    resolved = materialised(resolved_schemas(schemas_of(registry) if schemas is None else schemas, registry), "schemas")
    pairs, groups = aligned(registry, threshold, hints)
    made = materialised(edges(registry), "transforms")
    raised = flags(registry, made)
    if known_sources is not None:
        raised = raised.unionByName(unknown_source_flags(elements, known_sources))
    raised = materialised(curate.add_flags(stored, raised) if stored is not None else raised, "flags")
    return Run(registry, resolved, pairs, materialised(groups, "groups"), made, raised, summary(registry, made, raised, pairs))


def summary(registry: DataFrame, made: DataFrame, raised: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(kind, n): elements by type, transforms by function, flags by type, pairs by relation."""

    def counted(rows, head, column):
        return rows.groupBy(F.concat(F.lit(f"{head}:"), column).alias("kind")).agg(F.count("*").alias("n"))

    out = counted(registry, "element", "data_type").unionByName(counted(made, "transform", "function.function_type"))
    out = out.unionByName(counted(transforms.unknown_flags(made) if raised is None else raised, "flag", "flag_type"))
    return out if pairs is None else out.unionByName(counted(pairs, "pair", "relation"))
