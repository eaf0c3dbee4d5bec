"""More queries over the driver's tables: one or a few operators each, with the same questions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions import clock, identity, infer, parse, similarity, units
from regolith.operators import align, annotate, browse, curate, merge, ontology, quality, resolve, transforms

from .registry_queries import query, table

OBO = "http://purl.obolibrary.org/obo/"


def pick(column, *values):
    """The value at column modulo their number."""
    return F.element_at(F.array(*(v if hasattr(v, "alias") else F.lit(v) for v in values)), (column % len(values) + 1).cast("int"))


def sql_pick(column: str, *values: str) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def text(c) -> F.Column:
    return F.col(c).cast("string")


# --- strings and identity


@query(f"""
SELECT p_partkey, {sql_pick('p_size', "'uberon'", "'unknown'", "'unknown'")} AS prefix, {sql_pick('p_size', "'uberon'", "'schema'", "'interlex'")} AS aligned,
       CASE WHEN p_size % 2 = 0 THEN '{OBO}GO_' || p_size ELSE 'http://x/' || p_size END AS uri
FROM part
""")
def ontology_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    uri = pick(size, F.concat(F.lit(OBO + "UBERON_"), text("p_size")), "https://schema.org/a", "http://uri.interlex.org/b")
    curie = F.when(size % 2 == 0, F.concat(F.lit("GO:"), text("p_size"))).otherwise(F.concat(F.lit("http://x/"), text("p_size")))
    return parts(spark, sf_dir).select("p_partkey", infer.ontology_prefix(uri).alias("prefix"), infer.ontology_prefix_aligned(uri).alias("aligned"), infer.curie_to_uri(curie).alias("uri"))


@query("""
SELECT p_partkey, trim(replace(lower('  ' || p_name || '_' || p_brand || ' '), '_', ' ')) AS clean, substr(translate(lower(p_brand || '/' || p_type || ' ' || p_name), '/\\ :', '____'), 1, 100) AS file
FROM part
""")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("  "), "p_name", F.lit("_"), "p_brand", F.lit(" "))
    return parts(spark, sf_dir).select("p_partkey", infer.clean_name(name).alias("clean"), infer.file_name(F.concat("p_brand", F.lit("/"), "p_type", F.lit(" "), "p_name")).alias("file"))


@query("""
SELECT p_partkey,
       p_brand || ' ' || p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ': ' || p_type END || '. string kg' || CASE WHEN p_size % 2 = 0 THEN '. ' || p_type || ', x' ELSE '' END
         || CASE WHEN p_size % 5 = 0 THEN '. ' || p_brand || ', a' ELSE '' END AS embedding,
       p_name || ' ' || substr(p_type, 1, 200) || ' string kg ' || CASE WHEN p_size % 2 = 0 THEN p_type || ' x' ELSE '' END AS search
FROM part
""")
def described_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, none = F.col("p_size"), F.array().cast("array<string>")
    labels = F.when(size % 2 == 0, F.array("p_type", F.lit("x"))).otherwise(none)
    sources = F.when(size % 5 == 0, F.array("p_brand", F.lit("a"), F.lit("a"))).otherwise(F.array("p_brand"))
    about = F.when(size % 3 == 0, "").otherwise(F.col("p_type"))
    return parts(spark, sf_dir).select(
        "p_partkey", infer.embedding_text(F.col("p_brand"), F.col("p_name"), about, F.lit("string"), F.lit("kg"), labels, sources).alias("embedding"),
        infer.search_text(F.col("p_name"), F.col("p_type"), F.lit("string"), F.lit("kg"), labels).alias("search"),
    )


@query("""
SELECT p_partkey, sha256('{"data_type":"integer","unit":"' || CASE WHEN p_size % 2 = 0 THEN 'http://qudt.org/vocab/unit/KiloGM' ELSE p_brand END || '"}') AS sha256 FROM part
""")
def element_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.when(F.col("p_size") % 2 == 0, "http://qudt.org/vocab/unit/KiloGM")
    semantic = F.to_json(F.struct(F.col("p_type").alias("description"), F.lit("integer").alias("data_type"), F.col("p_brand").alias("unit"), uri.alias("unit_uri")))
    return parts(spark, sf_dir).select("p_partkey", identity.sha256(identity.canonical(semantic)).alias("sha256"))


@query("""
SELECT p_partkey, sha256(CASE WHEN p_size % 2 = 0 THEN '{}' ELSE '{"unit":"' || p_brand || '"}' END) AS sha256 FROM part
""")
def malformed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"unit":'), "p_brand")).otherwise(F.to_json(F.struct(F.col("p_brand").alias("unit"))))
    return parts(spark, sf_dir).select("p_partkey", identity.sha256(identity.canonical(raw)).alias("sha256"))


@query("""
SELECT p_partkey, substr(sha256(p_name), 1, 12) AS short, 'https://registry.example.org/elements/' || lower(p_brand) || '_' || substr(sha256(p_name), 1, 12) AS uri,
       substr(sha256(array_to_string(list_sort([p_name, p_brand, p_type]), '|')), 1, 16) AS checksum FROM part
""")
def hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("p_name", 256)
    return parts(spark, sf_dir).select("p_partkey", identity.short_key(sha).alias("short"), identity.entity_uri("elements", F.col("p_brand"), sha).alias("uri"), identity.checksum_of_set(F.array("p_name", "p_brand", "p_type")).alias("checksum"))


@query("""
SELECT p_partkey AS id, 'valid_type' AS rule FROM part WHERE p_size % 5 = 4 UNION ALL SELECT p_partkey, 'hash_integrity' FROM part WHERE p_size % 3 = 0
""")
def hash_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), pick(size, "string", "integer", "float", "object", "number").alias("data_type"), F.sha2(F.when(size % 3 == 0, "changed").otherwise(F.col("p_name")), 256).alias("sha256"), F.sha2("p_name", 256).alias("recomputed"))
    return quality.violations(rows, quality.entity_rules())


@query(f"SELECT p_partkey, {sql_pick('p_size', chr(39) + 'integer' + chr(39), chr(39) + 'boolean' + chr(39), chr(39) + 'string' + chr(39), chr(39) + 'string' + chr(39))} AS data_type FROM part")
def keyword_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", parse.keyword_type(pick(F.col("p_size"), "interval", "YesNo", "radio", "")).alias("data_type"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE coalesce(p_name, 'unknown') END AS name FROM part
""")
def derived_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = pick(F.col("p_size"), "values", "valuesets", "elements")
    provenance = F.array(F.struct(F.col("p_name").alias("name")), F.struct(F.lit("later").alias("name")))
    return parts(spark, sf_dir).select("p_partkey", annotate.derived_name(kind, F.col("p_brand"), F.col("p_type"), provenance).alias("name"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch(TIMESTAMP '2024-01-15 00:00:00') - epoch(date_trunc('second', ts)) > 86400 AS stale, 'nightly-' || strftime(ts, '%Y-%m-%d') AS version FROM events
""")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", clock.iso_utc(F.col("ts")).alias("iso"), clock.stale(F.col("ts"), now, 24).alias("stale"), clock.nightly_version(F.col("ts")).alias("version"))


# --- filters and pages


@query("SELECT p_partkey, p_size % 2 = 0 AS has, p_size % 2 <> 0 AS lacks, p_brand = 'Brand#11' OR p_brand = 'Brand#12' AS uses FROM part")
def element_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.array("p_type")).alias("ontology_annotations"), F.concat(F.lit("https://x/elements/a_"), "p_brand").alias("source_element"), F.lit("https://x/elements/b").alias("target_element"))
    return rows.select("p_partkey", browse.has_annotations().alias("has"), browse.has_annotations(False).alias("lacks"), (browse.touches("Brand#11") | browse.touches("Brand#12")).alias("uses"))


@query("SELECT count(*)::BIGINT AS total FROM part WHERE p_size > 10 AND contains(lower(p_name), 'a')")
def filtered_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.total(parts(spark, sf_dir).filter((F.col("p_size") > 10) & browse.says("A", "p_name")))


@query("SELECT sha256(p_partkey::VARCHAR) AS sha256, p_name AS name FROM part WHERE p_name IS NOT NULL ORDER BY p_name DESC, sha256(p_partkey::VARCHAR) LIMIT 21")
def elements_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select(F.sha2(text("p_partkey"), 256).alias("sha256"), F.col("p_name").alias("name"))
    return browse.page_of("elements", rows, "name", 20, descending=True)


@query("SELECT sha256(p_partkey::VARCHAR) AS sha256, 'p' || p_partkey || '.yaml' AS file_name FROM part WHERE p_partkey = 17")
def read_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select(F.sha2(text("p_partkey"), 256).alias("sha256"), F.concat(F.lit("p"), text("p_partkey"), F.lit(".yaml")).alias("file_name"))
    return browse.read_any(rows, "p17")


@query("SELECT p_partkey, list_contains(str_split(p_name, ' '), str_split(p_name, ' ')[1]) AND list_contains(str_split(p_name, ' '), 'red') AS found FROM part")
def full_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.split("p_name", " ")
    return parts(spark, sf_dir).select("p_partkey", browse.matches_all(tokens, F.array(tokens[0], F.lit("red"))).alias("found"))


@query("SELECT p_partkey, p_type AS data_type, p_brand AS unit FROM part")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("p_partkey", F.struct(F.col("p_type").alias("data_type"), F.col("p_brand").alias("unit")).alias("semantic"))
    return browse.flatten(rows, ("data_type", "unit")).drop("semantic")


@query(f"SELECT '{OBO}' || CASE WHEN p_size % 2 = 0 THEN 'NCBITaxon_' ELSE 'GO_' END || p_size AS uri, p_partkey FROM part WHERE p_size % 2 = 1 OR p_size IN (2, 10, 44)")
def relevant_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit(OBO), F.when(F.col("p_size") % 2 == 0, "NCBITaxon_").otherwise("GO_"), text("p_size"))
    return annotate.relevant(parts(spark, sf_dir).select(uri.alias("uri"), "p_partkey"), ["2", "10", "44"])


@query("SELECT p_partkey AS id, p_brand AS unknown FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')")
def sources_off_the_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.array(F.struct(F.col("p_brand").alias("source")), F.struct(F.lit("Brand#11").alias("source"))).alias("provenance"))
    return curate.unknown_sources(rows, ["Brand#11", "Brand#12"]).withColumn("unknown", F.array_join("unknown", ","))


# --- references


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN sha256(n_name) WHEN 1 THEN sha256(n_name) ELSE 'no such' END AS resolved
FROM orders JOIN nation ON n_nationkey = o_orderkey % 25
""")
def names_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    names = nations.select(F.explode(F.array_distinct(F.array("n_name", F.lower("n_name")))).alias("name"), F.sha2("n_name", 256).alias("sha256"))
    asked = table(spark, sf_dir, "orders").join(nations, F.col("o_orderkey") % 25 == F.col("n_nationkey")).select("o_orderkey", pick(F.col("o_orderkey"), F.col("n_name"), F.sha2("n_name", 256), "no such").alias("ref"))
    return resolve.by_name(asked, "ref", names).select("o_orderkey", "resolved")


@query("""
WITH o AS (SELECT p_partkey AS id, 0 AS "at", CASE WHEN p_size % 4 = 0 THEN 'https://x/' || p_size WHEN p_size % 2 = 0 THEN p_brand ELSE 'none' END AS value, p_type AS label FROM part)
SELECT id, "at", value, label, CASE WHEN starts_with(value, 'https://') THEN NULL WHEN value <> 'none' THEN 'b:' || value WHEN label LIKE 'S%' THEN 't:' || label END AS term FROM o
""")
def option_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    value = F.when(size % 4 == 0, F.concat(F.lit("https://x/"), text("p_size"))).when(size % 2 == 0, F.col("p_brand")).otherwise("none")
    rows = parts(spark, sf_dir)
    brands = rows.select(F.lower("p_brand").alias("name"), F.concat(F.lit("b:"), "p_brand").alias("uri")).distinct()
    kinds = rows.filter("p_type like 'S%'").select(F.lower("p_type").alias("name"), F.concat(F.lit("t:"), "p_type").alias("uri")).distinct()
    return resolve.options(rows.select(F.col("p_partkey").alias("id"), F.array(F.struct(value.alias("value"), F.col("p_type").alias("label"))).alias("options")), brands.union(kinds))


_MEMBERS = "WITH m AS (SELECT r_name AS id, n_name AS name, n_nationkey AS k, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS place FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _sets(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy(F.col("r_name").alias("id")).agg(F.array_sort(F.collect_list("n_name")).alias("members"))


@query(_MEMBERS + " SELECT id, string_agg('u' || k, ',' ORDER BY place) AS annotations FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS no FROM m WHERE k % 2 = 0) WHERE no <= 3 GROUP BY id")
def member_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotated = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("u"), text("n_nationkey"))).alias("annotations"))
    return resolve.member_annotations(_sets(spark, sf_dir), annotated, 3).withColumn("annotations", F.array_join("annotations", ","))


@query(_MEMBERS + """, b AS (SELECT id, 'u' || k AS term_uri, (k % 4) / 4.0 AS score, row_number() OVER (PARTITION BY id ORDER BY k % 4 DESC, place) AS no FROM m WHERE k % 4 > 0)
SELECT id, term_uri, round(score, 4)::DOUBLE AS score, 'skos:relatedMatch' AS relation FROM b WHERE no = 1
""")
def best_member_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotated = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("u"), text("n_nationkey")).alias("term_uri"), F.col("n_name").alias("term_label"), (F.col("n_nationkey") % 4 / 4.0).cast("double").alias("score"))
    return annotate.best_of_members(_sets(spark, sf_dir), annotated).select("id", "best.term_uri", "best.score", F.col("best.mapping_relation").alias("relation"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN sha256(c_name) ELSE 'gone' END AS entity_ref FROM customer")
def flags_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    made = rows.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("gone").alias("entity_ref"))
    return resolve.flag_refs(made, rows.select(F.col("c_name").alias("name"), F.sha2("c_name", 256).alias("sha256")))


@query("""
SELECT p_partkey AS id, 'T' || p_size AS term_uri, CASE WHEN p_size % 4 = 1 THEN 'missing' WHEN p_size % 4 = 2 THEN 'deprecated' ELSE 'unlike' END AS problem FROM part WHERE p_size % 4 > 0
""")
def terms_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.concat(F.lit("T"), text("p_size")).alias("term_uri"), F.when(size % 4 == 3, "xxx").otherwise("Some_Label").alias("name"))
    terms = parts(spark, sf_dir).filter("p_size % 4 <> 1").select(F.concat(F.lit("T"), text("p_size")).alias("uri"), F.lit("some label").alias("label"), (size % 4 == 2).alias("deprecated")).distinct()
    return ontology.verify(rows, terms)


# --- ontology


@query("SELECT n_regionkey AS ontology, count(*)::BIGINT AS n_terms FROM nation GROUP BY 1")
def ontology_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("ontology"), F.col("n_nationkey").alias("uri"))
    return ontology.term_counts(once.union(once))


@query("SELECT p_partkey AS uri, p_name AS label FROM part WHERE contains(lower(p_name), 'red') ORDER BY p_name, p_partkey LIMIT 20")
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.search(parts(spark, sf_dir).select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("label")), "RED")


@query("""
SELECT u AS uri, n_name AS label, n_regionkey::VARCHAR AS parents FROM (SELECT unnest(range(0, 30)) AS u) LEFT JOIN nation ON n_nationkey = u
""")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    terms = rows.select(F.col("n_nationkey").cast("bigint").alias("uri"), F.col("n_name").alias("label"), F.lit(None).cast("array<string>").alias("synonyms"), F.lit(False).alias("deprecated"))
    edges = rows.select(F.col("n_nationkey").cast("bigint").alias("child"), F.col("n_regionkey").alias("parent"))
    return ontology.lookup(terms, edges, spark.range(30).withColumnRenamed("id", "uri")).select("uri", "label", F.array_join(F.transform("parents", lambda p: p.cast("string")), ",").alias("parents"))


@query("""
SELECT n_nationkey AS name, CASE WHEN n_nationkey < 5 THEN 'new' WHEN n_nationkey > 20 THEN 'gone' WHEN n_nationkey % 2 = 0 THEN 'same' ELSE 'changed' END AS state FROM nation
""")
def ontology_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return ontology.changed_versions(rows.filter("n_nationkey >= 5").select(key.alias("name"), F.lit(0).alias("checksum")), rows.filter("n_nationkey <= 20").select(key.alias("name"), (key % 2).alias("checksum")))


@query("SELECT n_regionkey AS ontology, n_name AS label FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 2, r_name FROM region")
def ontology_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("ontology"), F.col("n_name").alias("label"))
    return ontology.reload(old, table(spark, sf_dir, "region").select(F.lit(2).alias("ontology"), F.col("r_name").alias("label")))


@query("SELECT DISTINCT p_size AS term_uri FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)")
def ungrouped_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.ungrouped(parts(spark, sf_dir).select(F.col("p_size").alias("term_uri")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("term_uri")))


@query(f"""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'http://own/' || p_size WHEN 1 THEN '{OBO}GO_' || p_size END AS term_uri, CASE p_size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'go' END AS ontology,
       CASE WHEN p_size % 3 < 2 THEN 1.0::DOUBLE END AS score FROM part
""")
def source_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    about = F.when(size % 3 < 2, F.concat(F.lit(f"see {OBO}GO_"), text("p_size"), F.lit(", and more"))).otherwise(F.col("p_type"))
    first = F.get(annotate.from_source(F.col("p_name"), about, F.when(size % 3 == 0, F.concat(F.lit("http://own/"), text("p_size")))), F.lit(0))
    return parts(spark, sf_dir).select("p_partkey", first["term_uri"].alias("term_uri"), first["ontology"].alias("ontology"), first["score"].alias("score"))


@query("""
WITH r AS (SELECT p_brand AS query, p_partkey AS item, p_name AS label, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part WHERE p_size = 7)
SELECT query, string_agg(item || ':' || label || ':' || CASE WHEN pos = 1 THEN 'true' ELSE 'false' END, '|' ORDER BY pos) || '|broad:world' AS annotations, count(*)::INT AS n_evidence FROM r GROUP BY 1
""")
def assigned_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    some = parts(spark, sf_dir).filter("p_size = 7")
    ranked = some.select(F.col("p_brand").alias("query"), F.lit("text").alias("text"), text("p_partkey").alias("item"), F.lit(0.9).alias("score"), F.lit("skos:closeMatch").alias("relation"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("position"))
    terms = some.select(text("p_partkey").alias("uri"), F.col("p_name").alias("label"), F.lit("d").alias("definition")).union(spark.sql("select 'broad', 'world', null"))
    up = some.select(text("p_partkey").alias("node"), F.lit("broad").alias("ancestor"), F.lit(1).alias("depth"))
    got = annotate.assigned(ranked, terms, up)
    told = F.transform("annotations", lambda a: F.when(a["mapping_relation"] == "skos:broadMatch", F.concat_ws(":", a["term_uri"], a["term_label"])).otherwise(F.concat_ws(":", a["term_uri"], a["term_label"], a["primary"].cast("string"))))
    return got.select("query", F.array_join(told, "|").alias("annotations"), F.size("evidence").alias("n_evidence"))


# --- aliases and transforms


_ALIASES = """
WITH e AS (SELECT vec_id AS id, label % 3 AS t, CASE WHEN vec_id % 5 > 0 THEN 'T' || (vec_id % 40) END AS s, CASE WHEN vec_id % 4 > 0 THEN embedding::DOUBLE[] END AS v,
             list_distinct(['c' || (vec_id % 7), 'd' || (vec_id % 5), 'yes']) AS c, CASE WHEN vec_id % 11 = 0 THEN ['h' || (vec_id % 22), 'g'] ELSE [] END AS h, label::DOUBLE AS a, (label + vec_id % 10)::DOUBLE AS z FROM embeddings),
     p AS (SELECT x.id AS a_id, y.id AS b_id, CASE WHEN x.s = y.s THEN 1.0 ELSE 0.0 END AS o,
                  CASE WHEN x.v IS NULL OR y.v IS NULL THEN 0.0 ELSE greatest(0, least(1, list_cosine_similarity(x.v, y.v))) END AS e,
                  CASE WHEN x.z < y.a OR y.z < x.a THEN 0.0 WHEN greatest(x.z, y.z) = least(x.a, y.a) THEN 1.0 ELSE greatest(least(x.z, y.z) - greatest(x.a, y.a), 0) / (greatest(x.z, y.z) - least(x.a, y.a)) END AS r,
                  len(list_intersect(x.c, y.c)) / len(list_distinct(list_concat(x.c, y.c))) AS j, len(list_intersect(x.h, y.h)) > 0 AS hinted
           FROM e x JOIN e y ON x.t = y.t AND x.id < y.id),
     w AS (SELECT *, 0.4 * o + 0.3 * e + 0.15 * r + 0.15 * j AS raw FROM p)
SELECT a_id, b_id, CASE WHEN hinted THEN greatest(round(raw, 4), 0.95) ELSE round(raw, 4) END AS score, hinted FROM w WHERE CASE WHEN hinted THEN greatest(round(raw, 4), 0.95) ELSE round(raw, 4) END >= 0.5
"""


@query(_ALIASES)
def alias_pairs_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, label = F.col("vec_id"), F.col("label")
    none = F.array().cast("array<string>")

    def named(letter, modulus):
        return F.concat(F.lit(letter), (key % modulus).cast("string"))

    rows = table(spark, sf_dir, "embeddings").select(
        key.alias("id"), (label % 3).cast("string").alias("data_type"), F.when(key % 5 > 0, named("T", 40)).alias("term_uri"), label.cast("double").alias("min_value"), (label + key % 10).cast("double").alias("max_value"),
        F.array(named("c", 7), named("d", 5), F.lit("yes")).alias("choices"), F.when(key % 4 > 0, F.col("embedding")).alias("vector"), F.when(key % 11 == 0, F.array(named("h", 22), F.lit("g"))).otherwise(none).alias("hints"),
    )
    return align.candidates(rows).select("a_id", "b_id", "score", "hinted")


@query("""
WITH e AS (SELECT p_partkey AS id, p_brand AS b, p_type AS t FROM part WHERE p_size % 10 = 0)
SELECT x.id AS a_id, y.id AS b_id, 0.7::DOUBLE AS score FROM e x JOIN e y ON x.b = y.b AND x.t = y.t AND x.id < y.id
""")
def alias_pairs_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names stand in where vectors are missing: elements of one brand as type, one type as term and name."""
    nothing = F.lit(None)
    rows = parts(spark, sf_dir).filter("p_size % 10 = 0").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("data_type"), F.col("p_type").alias("term_uri"), nothing.cast("double").alias("min_value"), nothing.cast("double").alias("max_value"),
        F.array().cast("array<string>").alias("choices"), nothing.cast("array<float>").alias("vector"), nothing.cast("array<string>").alias("hints"), F.col("p_type").alias("name"),
    )
    return align.candidates(rows, 0.6).select("a_id", "b_id", "score")


@query("""
WITH p AS (SELECT l_orderkey AS a_id, l_linenumber AS b_id, l_discount AS score FROM lineitem)
SELECT a_id, b_id, score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id)::INT AS rank FROM p
""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.ranked(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a_id"), F.col("l_linenumber").alias("b_id"), F.col("l_discount").alias("score")))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'years_from_iso8601_duration' WHEN p_size % 3 = 1 THEN 'value * 0.25' ELSE 'x' END AS expression, CASE WHEN p_size % 3 = 1 THEN 0.25::DOUBLE END AS factor, 'b' AS input_type FROM part
""")
def reversed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    made = F.struct(
        pick(size, "type_conversion", "unit_conversion", "structural").alias("function_type"), F.lit("a").alias("input_type"), F.lit("b").alias("output_type"), pick(size, "iso8601_duration_from_years", "value * 4.0", "x").alias("expression"),
        F.lit("none").alias("expression_type"), F.when(size % 3 == 1, 4.0).alias("factor"),
    ).cast(transforms.FUNCTION)
    back = transforms.reverse(made)
    return parts(spark, sf_dir).select("p_partkey", back["expression"].alias("expression"), back["factor"].alias("factor"), back["input_type"].alias("input_type"))


@query("""
WITH e AS (SELECT p_partkey AS id, p_size AS s, list_sort(list_distinct(str_split(p_name, ' '))) AS c FROM part),
     p AS (SELECT x.id AS a_id, y.id AS b_id, len(list_intersect(x.c, y.c)) AS k, len(list_distinct(list_concat(x.c, y.c))) AS n FROM e x JOIN e y ON x.s = y.s AND x.id < y.id)
SELECT a_id, b_id, CASE WHEN k < n AND k / n > 0.3 THEN 'value_mapping' ELSE 'identity' END AS function_type FROM p
""")
def mapped_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    rows = parts(spark, sf_dir).select(
        F.col("p_partkey").alias("id"), F.lit("s").alias("source"), text("p_size").alias("term_uri"), nothing.alias("name"), F.sha2(text("p_partkey"), 256).alias("sha256"), F.lit("string").alias("data_type"),
        nothing.alias("unit"), nothing.alias("value_domain"), F.split("p_name", " ").alias("choices"), nothing.alias("structural_type"),
    )
    return transforms.generate(rows).select("a_id", "b_id", "function.function_type")


@query("SELECT 'transform' AS entity_type, sha256(p_name) AS entity_ref, 'needs_review' AS flag_type, 'pending' AS status FROM part WHERE p_size % 2 = 0")
def unknown_transform_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "unknown").otherwise("identity")
    return transforms.unknown_flags(parts(spark, sf_dir).select(F.sha2("p_name", 256).alias("sha256"), F.struct(kind.alias("function_type")).alias("function")))


@query("SELECT s_suppkey, CASE WHEN s_nationkey > 0 THEN s_suppkey::DOUBLE / s_nationkey END AS factor, CASE s_suppkey % 2 WHEN 0 THEN 1000.0::DOUBLE END AS known FROM supplier")
def conversion_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", units.conversion_factor(F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")).alias("factor"), units.known_factor(F.lit("kilogram"), pick(F.col("s_suppkey"), "gram", "day")).alias("known"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || ',' || p_type WHEN 1 THEN p_name ELSE '' END AS choices FROM part")
def element_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    options = F.when(size % 3 == 0, F.array(F.struct(F.col("p_brand").alias("value")), F.struct(F.col("p_type").alias("value"))))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(similarity.choices_of(options, F.when(size % 3 == 1, F.array("p_name"))), ",").alias("choices"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN p_brand <> p_type THEN 'name:' || p_brand || '>' || p_type END, CASE WHEN p_size % 2 = 0 THEN 'required:true>false' END], lambda x: x IS NOT NULL), ';') END AS diff FROM part
""")
def provenance_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")

    def entry(source, name, required):
        return F.struct(F.lit(source).alias("source"), F.col(name).alias("name"), F.lit("d").alias("description"), required.alias("required"), F.lit(None).cast("boolean").alias("multivalued"))

    both = F.array(entry("a", "p_brand", F.lit(True)), entry("b", "p_type", size % 2 == 1))
    diff = annotate.provenance_diff(F.when(size % 3 == 0, F.slice(both, 1, 1)).otherwise(both))
    told = F.transform(diff, lambda d: F.concat(d["field"], F.lit(":"), d["value_a"], F.lit(">"), d["value_b"]))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(told, ";").alias("diff"))


# --- curation, runs and sinks


@query("""
WITH s AS (SELECT o_orderkey AS flag_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'resolved' END AS status, CASE WHEN o_orderstatus <> 'O' THEN 'before' END AS resolved_by FROM orders)
SELECT flag_id, CASE WHEN status = 'pending' AND flag_id % 2 = 0 THEN 'rejected' ELSE status END AS status, CASE WHEN status = 'pending' AND flag_id % 2 = 0 THEN 'now' ELSE resolved_by END AS resolved_by FROM s
""")
def flags_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, open_ = table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O"
    stored = rows.select(F.col("o_orderkey").alias("flag_id"), F.when(open_, "pending").otherwise("resolved").alias("status"), F.when(~open_, "before").alias("resolved_by"))
    decisions = rows.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("flag_id"), F.lit("rejected").alias("status"), F.lit("now").alias("resolved_by"))
    return curate.resolve_flags(stored, decisions, F.lit("2026-01-01T00:00:00Z")).select("flag_id", "status", "resolved_by")


@query("""
WITH s AS (SELECT DISTINCT p_brand AS entity_ref, 'a' AS flag_type FROM part WHERE p_size < 5), f AS (SELECT DISTINCT p_brand AS entity_ref, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS flag_type FROM part)
SELECT entity_ref, flag_type FROM s UNION SELECT entity_ref, flag_type FROM f
""")
def flags_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    stored = rows.filter("p_size < 5").select(F.col("p_brand").alias("entity_ref"), F.lit("a").alias("flag_type")).distinct()
    return curate.add_flags(stored, rows.select(F.col("p_brand").alias("entity_ref"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("flag_type")))


@query("SELECT o_orderkey AS flag_id, 'pending' AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("flag_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"))
    return curate.queue(rows, status="pending")


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'approved' WHEN p_size % 4 = 1 THEN 'rejected' ELSE 'pending' END AS state, p_size % 4 < 2 AS moved FROM part
""")
def proposals_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, size = parts(spark, sf_dir), F.col("p_size")
    return curate.step(rows.select(F.col("p_partkey").alias("id"), F.lit("pending").alias("state")), rows.filter("p_size % 4 < 3").select(F.col("p_partkey").alias("id"), pick(size, "approved", "rejected", "done", "none").alias("to")))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'u2:true,u1:false' WHEN 1 THEN 'u1:true,u2:false' ELSE 'u1:true,u2:false' END AS approved, 'u1' AS left_over FROM part
""")
def annotations_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(uri, primary):
        return F.struct(F.lit(uri).alias("term_uri"), F.lit("skos:closeMatch").alias("mapping_relation"), F.lit(primary).alias("primary"))

    both = F.array(one("u1", True), one("u2", False))
    chosen = pick(F.col("p_size"), F.array_join(F.transform(curate.approve(both, "u2"), lambda a: F.concat_ws(":", a["term_uri"], a["primary"].cast("string"))), ","), F.array_join(F.transform(curate.approve(both, "u1"), lambda a: F.concat_ws(":", a["term_uri"], a["primary"].cast("string"))), ","), F.array_join(F.transform(curate.approve(both, "u9"), lambda a: F.concat_ws(":", a["term_uri"], a["primary"].cast("string"))), ","))
    return parts(spark, sf_dir).select("p_partkey", chosen.alias("approved"), F.array_join(F.transform(curate.reject(both, "u2"), lambda a: a["term_uri"]), ",").alias("left_over"))


@query("""
WITH k AS (SELECT p_partkey::VARCHAR AS k, p_size, p_name FROM part), fine AS (SELECT k FROM k WHERE p_size % 3 = 0)
SELECT k AS sha256, CASE WHEN k IN (SELECT k FROM fine) THEN 'superseded' ELSE 'current' END AS status, CASE WHEN k IN (SELECT k FROM fine) THEN 'n' || k END AS superseded_by, p_name AS name, 1 AS n_provenance FROM k
UNION ALL SELECT 'n' || k, 'current', NULL, 'changed', 2 FROM fine
""")
def versions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    key, nothing = text("p_partkey"), F.lit(None).cast("string")
    stored = rows.select(key.alias("sha256"), F.lit("current").alias("status"), nothing.alias("superseded_by"), F.array(F.struct(F.lit("bids").alias("source"), F.lit("x").alias("name"))).alias("provenance"), F.col("p_name").alias("name"))
    # changes to a hash that is taken, to the same one, or of an unknown row are refused
    new = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("n"), key)).when(F.col("p_size") % 3 == 1, key).otherwise("1")
    changes = rows.select(key.alias("sha256"), new.alias("new_sha256"), F.lit("me").alias("by"), F.lit("changed").alias("name")).filter("sha256 <> '1' or new_sha256 <> '1'").union(spark.sql("select 'no such', 'n0', 'me', 'x'"))
    done, _ = curate.applied_versions(stored, changes, F.lit("2026-01-01T00:00:00Z"))
    return done.select("sha256", "status", "superseded_by", "name", F.size("provenance").alias("n_provenance"))


@query("SELECT s_suppkey AS repository_url, CASE WHEN s_nationkey < 5 THEN 'bids' ELSE 'other' END AS adapter_type, CASE WHEN s_nationkey < 5 THEN 'approved' ELSE 'pending' END AS status, s_nationkey < 5 AS auto_approved FROM supplier WHERE s_suppkey % 3 > 0")
def datasets_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    found = rows.select(F.col("s_suppkey").alias("url"), F.when(F.col("s_nationkey") < 5, "openneuro").otherwise("zenodo").alias("source"), F.lit("other").alias("adapter"))
    return curate.queued_datasets(found.union(found), rows.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("repository_url")), {"openneuro": "bids"})


@query("""SELECT c_custkey AS actor, sha256('{"actor":' || c_custkey || ',"action":"edit","entity_type":"element","entity_ref":"' || c_name || '","details":{"a":"1","b":"' || c_mktsegment || '"}}') AS audit_id FROM customer""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = F.create_map(F.lit("b"), F.col("c_mktsegment"), F.lit("a"), F.lit("1"))
    acts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("actor"), F.lit("edit").alias("action"), F.lit("element").alias("entity_type"), F.col("c_name").alias("entity_ref"), details.alias("details"))
    return curate.audit(acts, F.lit("2026-01-01T00:00:00Z")).select("actor", "audit_id")


@query("SELECT p_partkey AS sha256, 3 AS n_novel FROM part WHERE p_size % 2 = 0")
def bloated_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.array(F.lit("a"))
    after = F.when(F.col("p_size") % 2 == 0, F.array(*(F.lit(x) for x in "abcd"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return curate.bloated(parts(spark, sf_dir).select(F.col("p_partkey").alias("sha256"), before.alias("before"), after.alias("after")))


@query("SELECT CASE WHEN p_size % 5 = 0 THEN 'skipped' WHEN p_size % 5 = 1 OR p_size % 5 = 2 THEN 'failed' ELSE 'ok' END AS status, count(*)::BIGINT AS n FROM part GROUP BY 1")
def batch_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_size") % 5
    return quality.batch_counts(parts(spark, sf_dir).select((m == 0).alias("known"), F.when(m == 1, "broken").alias("error"), F.when(m == 2, 0).otherwise(7).alias("rows")))


@query("""
WITH e AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size <= 20), x AS (SELECT DISTINCT p_brand, s FROM part, (SELECT unnest(range(15, 25)) AS s))
SELECT x.p_brand AS class, x.s::VARCHAR AS name, CASE WHEN e.p_size IS NULL THEN 'missing' WHEN x.s % 2 = 0 THEN 'right' ELSE 'wrong_type' END AS state FROM x LEFT JOIN e ON e.p_brand = x.p_brand AND e.p_size = x.s
""")
def extraction_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    found = rows.filter("p_size <= 20").select(F.col("p_brand").alias("class"), text("p_size").alias("name"), F.lit("even").alias("category"))
    wanted = rows.select("p_brand").distinct().select(F.col("p_brand").alias("class"), F.explode(F.sequence(F.lit(15), F.lit(24))).alias("s"))
    return quality.type_checks(found, wanted.select("class", text("s").alias("name"), F.when(F.col("s") % 2 == 0, "even").otherwise("odd").alias("category"))).select("class", "name", "state")


@query("SELECT p_partkey AS id, 'p_name' AS field FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 UNION ALL SELECT p_partkey, 'p_type' FROM part WHERE p_size % 2 = 1 AND p_size % 5 = 0")
def required_field_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), pick(size, "even", "odd").alias("category"), F.when(size % 3 > 0, F.col("p_name")).alias("p_name"), F.when(size % 5 > 0, F.col("p_type")).otherwise("").alias("p_type"))
    return quality.required_fields(rows, {"even": ["p_name"], "odd": ["p_type"]})


@query("SELECT p_brand AS entity_type, count(*)::BIGINT AS expected, count(*) FILTER (WHERE p_size > 1)::BIGINT AS found FROM part GROUP BY 1 HAVING count(*) <> count(*) FILTER (WHERE p_size > 1)")
def manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    def n(rows):
        return rows.groupBy(F.col("p_brand").alias("entity_type")).agg(F.count("*").alias("n"))

    return quality.manifest_check(n(parts(spark, sf_dir)), n(parts(spark, sf_dir).filter("p_size > 1")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS no FROM orders) WHERE no = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("""
SELECT p_partkey AS sha256, CASE WHEN p_size % 3 = 0 THEN '"new"' WHEN p_size % 3 = 1 THEN '"old"' ELSE '"old"' END AS unit, CASE WHEN p_size % 3 = 1 THEN 'b' ELSE 'a' END AS source FROM part
""")
def updated_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").alias("sha256")
    stored = parts(spark, sf_dir).select(key, F.create_map(F.lit("unit"), F.lit('"old"'), F.lit("x"), F.lit("1")).alias("semantic"), F.array(F.struct(F.lit("a").alias("source"))).alias("provenance"))
    changes = parts(spark, sf_dir).filter("p_size % 3 < 2").select(key, pick(F.col("p_size"), "unit", "provenance", "-").alias("key"), pick(F.col("p_size"), '"new"', '[{"source":"b"}]', "-").alias("value"))
    return merge.update(stored, changes).select("sha256", F.element_at("semantic", "unit").alias("unit"), F.col("provenance")[0]["source"].alias("source"))


@query("""
SELECT 'elements' AS kind, count(*)::BIGINT AS n FROM part UNION ALL SELECT 'flags', count(*)::BIGINT FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL SELECT 'values', (SELECT count(*) FROM nation)::BIGINT UNION ALL SELECT 'transforms', (SELECT count(*) FROM region)::BIGINT
""")
def registry_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)

    def entities(df, version):
        return df.select(text("p_partkey").alias("sha256"), F.lit(version).alias("version"), F.array(F.struct(F.lit("s").alias("source"), F.col("p_name").alias("name"))).alias("provenance"))

    def flagged(df):
        return df.select(F.col("p_brand").alias("entity_ref"), F.lit("f").alias("flag_type")).distinct()

    stored = {"elements": entities(rows.filter("p_size < 30"), 1), "flags": flagged(rows.filter("p_size < 10")), "values": table(spark, sf_dir, "nation").select(text("n_nationkey").alias("sha256"))}
    fresh = {"elements": entities(rows.filter("p_size > 20"), 2), "flags": flagged(rows), "transforms": table(spark, sf_dir, "region").select(text("r_regionkey").alias("sha256"))}
    out = None
    for kind, df in merge.imported(stored, fresh).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'v2' ELSE 'v1' END AS sources FROM customer")
def replacing_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    def versioned(df, no):
        return df.select("c_custkey", F.sha2(text("c_custkey"), 256).alias("sha256"), F.lit(no).alias("version"), F.array(F.struct(F.lit(f"v{no}").alias("source"), F.lit("n").alias("name"))).alias("provenance"))

    rows = table(spark, sf_dir, "customer")
    done = merge.upsert(versioned(rows, 1), versioned(rows.filter("c_acctbal < 0"), 2), merge=False)
    return done.select("c_custkey", F.array_join(F.transform("provenance", lambda p: p["source"]), ",").alias("sources"))
