"""Queries that write files from the driver's tables and read them back: readers, sources and stores against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators import browse, quality
from regolith.sources import dictionaries, linkml, ontologies, registry_source, stores
from regolith.sources.catalog import Catalog
from regolith.sources.documents import entities

from .registry_queries import query, table
from .structure_queries import scratch

RDFS, OIO, OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.geneontology.org/formats/oboInOwl#", "http://www.w3.org/2002/07/owl#"

_TERMS = """
SELECT 'http://x.org/p' || p_partkey AS uri, p_name AS label, array_to_string(list_sort(list_distinct([p_brand, p_type || ' "' || chr(10) || 'and more. ' || p_size])), '|') AS synonyms,
       p_size % 7 = 0 AS deprecated, 'http://x.org/s' || p_size AS parent FROM part
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("synonym", F.concat("p_type", F.lit(' "\nand more. '), "p_size"))


def _told(terms: DataFrame) -> DataFrame:
    return terms.select("uri", "label", F.array_join("synonyms", "|").alias("synonyms"), "deprecated", F.col("parents")[0].alias("parent"))


@query(_TERMS)
def turtle_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements over several lines, with long strings in which dots and quotes end nothing."""
    parts = _parts(spark, sf_dir)
    text = F.concat(
        F.lit("<http://x.org/p"), "p_partkey", F.lit(f"> <{RDFS}label> \""), "p_name", F.lit(f"\" ; # told\n  <{OIO}hasExactSynonym> '''"), "synonym", F.lit("''' ,\n \""), "p_brand", F.lit(f"\"@en ;\n <{RDFS}subClassOf> <http://x.org/s"), "p_size",
        F.lit(f"> , [ <{OWL}onProperty> <http://x.org/q> ] ; <{OWL}deprecated> "), (F.col("p_size") % 7 == 0).cast("string"), F.lit(" ."),
    )
    path = scratch(spark, "turtle")
    parts.select(text.alias("value")).write.text(path)
    return _told(ontologies.rdf_terms(spark, path, "x", "ttl"))


@query(_TERMS)
def rdf_xml_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each brand, its classes below the root."""
    def escaped(c):
        return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    node = F.concat(
        F.lit('<owl:Class rdf:about="&x;p'), "p_partkey", F.lit('"><rdfs:label>'), escaped(F.col("p_name")), F.lit("</rdfs:label><!-- <x> --><oio:hasExactSynonym>"), escaped(F.col("synonym")), F.lit("</oio:hasExactSynonym><oio:hasExactSynonym><![CDATA["), "p_brand",
        F.lit(']]></oio:hasExactSynonym><rdfs:subClassOf rdf:resource="s'), "p_size", F.lit('"/>'), F.when(F.col("p_size") % 7 == 0, "<owl:deprecated>true</owl:deprecated>").otherwise(""), F.lit("</owl:Class>\n"),
    )
    head = f'<!DOCTYPE rdf:RDF [<!ENTITY x "http://x.org/">]>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="{RDFS}" xmlns:owl="{OWL}" xmlns:oio="{OIO}" xml:base="http://x.org/">\n'
    docs = _parts(spark, sf_dir).groupBy("p_brand").agg(F.concat(F.lit(head), F.array_join(F.collect_list(node), ""), F.lit("</rdf:RDF>")).alias("value"))
    path = scratch(spark, "rdf-xml")
    docs.write.partitionBy("p_brand").text(path)
    return _told(ontologies.rdf_terms(spark, path, "x", "xml"))


@query("""
SELECT DISTINCT p_brand AS class, p_type AS name, CASE p_size % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'string' ELSE 'float' END AS data_type, CASE WHEN p_size % 2 = 0 THEN 'kg' END AS unit
FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1
""")
def linkml_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as classes and types as their attributes, written as a LinkML schema and read back."""
    size, first = F.col("p_size"), F.min_by(F.struct("p_size"), "p_partkey").alias("r")
    rows = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(first).select("p_brand", "p_type", "r.p_size")
    kind = F.when(size % 3 == 0, "integer").when(size % 3 == 1, "string").otherwise("float")
    attributes = entities(rows, entity_type="attribute", source="parts", **{"class": F.col("p_brand")}, name=F.col("p_type"), data_type=kind, unit=F.when(size % 2 == 0, "kg"))
    classes = rows.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("m"))
    written = linkml.documents(attributes.unionByName(entities(classes, entity_type="class", source="parts", **{"class": F.col("p_brand")}, name=F.col("p_brand"), members=F.col("m"))))
    read = linkml.extract_docs(written.select("file", F.try_parse_json("text").alias("doc")))
    return read.filter("entity_type = 'attribute'").select("class", "name", "data_type", "unit")


@query("""
SELECT p_name || ' ' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' ELSE 'string' END AS data_type, 'made by ' || p_brand || ', "' || p_type || '"' AS description FROM part
""")
def csv_dictionary_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary written as CSV, with quotes and commas in it, and read by the dictionary reader."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.when(size % 3 == 0, "integer").when(size % 3 == 1, "float").otherwise("text").alias("type"), F.concat(F.lit("made by "), "p_brand", F.lit(', "'), "p_type", F.lit('"')).alias("label"),
    )
    path = scratch(spark, "dictionary")
    rows.write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
    return dictionaries.csv_dictionary(spark, path).select("name", "data_type", "description")


@query("SELECT p_partkey::VARCHAR AS name, p_brand AS source, p_size::DOUBLE AS min_value FROM part WHERE p_brand IN ('Brand#11', 'Brand#23') AND p_size > 10")
def registry_folder_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of entities by type and source, read by the registry format with filters on both."""
    path = scratch(spark, "store")
    stores.write(entities(table(spark, sf_dir, "part"), entity_type="attribute", source=F.col("p_brand"), name=F.col("p_partkey").cast("string"), min_value=F.col("p_size").cast("double")), path)
    registry_source.register(spark)
    rows = spark.read.format("registry").load(path)
    return rows.filter("entity_type = 'attribute' and source in ('Brand#11', 'Brand#23') and min_value > 10").select("name", "source", "min_value")


@query("""
WITH n AS (SELECT p_type AS name, CASE WHEN bool_or(p_size % 2 = 0) THEN 2 ELSE 1 END AS k FROM part GROUP BY p_type)
SELECT name, k AS n_provenance, name LIKE '%BRASS' AS flagged FROM n
""")
def catalog_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as elements of a catalog; those that stand for an even size get a second provenance entry, and those of brass a flag."""
    parts = table(spark, sf_dir, "part")
    catalog = Catalog(spark, scratch(spark, "catalog"), 8)
    first = F.array(F.struct(F.lit("tpch").alias("source"), F.lit("part").alias("class"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("description")))
    rows = parts.select("p_type").distinct().select(F.create_map(F.lit("data_type"), F.lit('"string"')).alias("semantic"), first.alias("provenance"))
    catalog.entities.write_batch("elements", rows, "all")
    name = F.col("provenance")[0]["name"]
    known = catalog.entities.list("elements", source="tpch", data_type="string").select("sha256", name.alias("p_type"))
    more = parts.filter("p_size % 2 = 0").select("p_type").distinct().join(known, "p_type")
    entry = F.array(F.struct(F.lit("even").alias("source"), F.lit("part").alias("class"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("description")))
    catalog.entities.merge_provenance("elements", more.select("sha256", entry.alias("provenance")))
    brass = known.filter("p_type like '%BRASS'").select(F.lit("element").alias("entity_type"), F.col("sha256").alias("entity_ref"), F.lit("brass").alias("flag_type"), F.lit("{}").alias("context"))
    catalog.flags.write(brass, F.lit("now"))
    flagged = catalog.flags.read("pending", "brass").select(F.col("entity_ref").alias("sha256"), F.lit(True).alias("_flagged"))
    both = catalog.entities.list("elements").join(flagged, "sha256", "left")
    return both.select(name.alias("name"), F.size("provenance").alias("n_provenance"), F.coalesce("_flagged", F.lit(False)).alias("flagged"))


@query("""
WITH e AS (SELECT CASE WHEN p_size % 10 = 0 THEN 'enum_value' WHEN p_size % 3 = 0 THEN 'class' ELSE 'attribute' END AS t, p_brand AS class, p_type AS name, CASE WHEN p_size % 7 > 0 THEN 'string' END AS data_type FROM part),
     n AS (SELECT t, count(*) AS n FROM e GROUP BY t),
     k(class, name, wanted) AS (VALUES ('Brand#11', 'nothing of the kind', 'class'), ('Brand#11', 'ECONOMY BRASS', 'attribute'), ('Brand#23', 'STANDARD TIN', NULL))
SELECT 'missing' AS issue, 'valueset' AS entity_type, NULL AS class, NULL AS name, '3' AS expected, '0' AS found
UNION ALL SELECT 'unexpected', t, NULL, NULL, '5', n::VARCHAR FROM n WHERE t = 'class' AND n > 5
UNION ALL SELECT 'classification', t, class, name, 'attribute', t FROM e WHERE class = 'Brand#12' AND t <> 'attribute'
UNION ALL SELECT 'missing', wanted, class, name, coalesce(wanted, 'any'), NULL FROM k WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.class = k.class AND e.name = k.name)
UNION ALL SELECT 'classification', t, class, name, wanted, t FROM e JOIN k USING (class, name) WHERE wanted <> t
UNION ALL SELECT 'field', t, class, name, 'data_type', NULL FROM e WHERE t = 'attribute' AND data_type IS NULL
""")
def extraction_against_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, categories, known entities and required fields of parts as extracted entities."""
    size = F.col("p_size")
    rows = entities(
        table(spark, sf_dir, "part"), entity_type=F.when(size % 10 == 0, "enum_value").when(size % 3 == 0, "class").otherwise("attribute"), **{"class": F.col("p_brand")}, name=F.col("p_type"), data_type=F.when(size % 7 > 0, "string"),
    )
    known = [{"class": "Brand#11", "name": "nothing of the kind", "type": "class"}, {"class": "Brand#11", "name": "ECONOMY BRASS", "type": "attribute"}, {"class": "Brand#23", "name": "STANDARD TIN"}]
    spec = {"expected_types": {"valueset": {"min": 3}, "class": {"min": 1, "max": 5}, "attribute": {"min": 0}}, "category_rules": {"Brand#12": "attribute"}, "known_entities": known, "required_fields": {"attribute": ["data_type"]}}
    return quality.extraction_issues(rows, spec)


@query("""
SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' AND starts_with(o_orderpriority, '1')) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50
""")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: the newest of a status whose priority begins so."""
    rows = table(spark, sf_dir, "orders")
    return browse.newest(rows, "o_orderdate", "o_orderkey", equal={"o_orderstatus": "F", "o_custkey": None}, prefix={"o_orderpriority": "1"}).select("o_orderkey", "o_orderstatus")
