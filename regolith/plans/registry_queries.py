"""Queries over the driver's tables, by name, with the same questions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regolith.functions import identity, infer, parse, similarity, units
from regolith.operators import align, browse, curate, graph, merge, ontology, quality, resolve, search, transforms
from regolith.operators import vectors as vec
from regolith.sources import dictionaries
from regolith.streaming.windows import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT sha256(text) AS sha256, count(*)::BIGINT AS n_rows,
       array_to_string(list_sort(list(DISTINCT source || '/' || lang)), ',') AS provenance
FROM documents WHERE text IS NOT NULL GROUP BY 1
""")
def content_address_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as content-addressed rows, their provenance united by the merge of the registry."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    rows = docs.select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("ord"), F.array(F.struct("source", F.col("lang").alias("name"))).alias("provenance"))
    named = F.transform("provenance", lambda p: F.concat_ws("/", p["source"], p["name"]))
    return merge.merge_by_hash(rows).select("sha256", "n_rows", F.array_join(F.array_sort(named), ",").alias("provenance"))


# --- identity and merge


def _parts(spark, sf_dir):
    """Parts as elements: a unit, a term for even sizes, a class and a name."""
    term = F.concat(F.lit("http://purl.obolibrary.org/obo/PART_"), F.col("p_size").cast("string"))
    annotation = F.struct(term.alias("term_uri"), F.lit("x").alias("term_label"), F.lit("skos:exactMatch").alias("mapping_relation"), F.lit("concept_match").alias("match_level"), F.lit(1.0).alias("score"), F.lit(True).alias("primary"))
    return table(spark, sf_dir, "part").withColumn("annotations", F.when(F.col("p_size") % 2 == 0, F.array(annotation)))


@query("""
SELECT p_partkey, sha256(CASE WHEN p_size % 2 = 0
  THEN '{"_primary_ontology_uri":"http://purl.obolibrary.org/obo/PART_' || p_size || '","data_type":"string","unit":"' || p_brand || '"}'
  ELSE '{"_attribute":"' || p_name || '","_class":"' || p_type || '","data_type":"string","unit":"' || p_brand || '"}' END) AS sha256
FROM part
""")
def identity_two_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    semantic = F.to_json(F.struct(F.lit("string").alias("data_type"), F.lit("not hashed").alias("question_text"), F.col("p_brand").alias("unit")))
    provenance = F.array(F.struct(F.col("p_type").alias("class"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("description")))
    return parts.select("p_partkey", identity.sha256(identity.identity_json(semantic, provenance, F.col("annotations"))).alias("sha256"))


@query("""
SELECT sha256('{"data_type":"' || p_type || '","unit":"' || p_brand || '"}') AS sha256, count(*)::BIGINT AS n_rows,
       string_agg(DISTINCT p_brand || '/' || p_type, ',') AS provenance
FROM part GROUP BY 1
""")
def canonical_flat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = identity.sha256(identity.canonical_flat({"data_type": F.col("p_type"), "unit": F.col("p_brand"), "description": F.col("p_name")}))
    rows = table(spark, sf_dir, "part").select(sha.alias("sha256"), F.col("p_partkey").alias("ord"), F.array(F.struct(F.col("p_brand").alias("source"), F.col("p_type").alias("name"))).alias("provenance"))
    merged = merge.merge_by_hash(rows)
    return merged.select("sha256", "n_rows", F.array_join(F.transform("provenance", lambda p: F.concat_ws("/", p["source"], p["name"])), ",").alias("provenance"))


@query("""
WITH h AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL)
SELECT sha256 FROM h WHERE starts_with(sha256, 'a') ORDER BY sha256 LIMIT 1
""")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = table(spark, sf_dir, "documents").filter("text is not null").select(F.sha2("text", 256).alias("sha256")).distinct()
    return browse.by_prefix(hashes, "a")


@query("""
SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS n_versions
FROM customer WHERE c_acctbal >= 0
UNION ALL
SELECT c_custkey, 'UPDATED' AS c_mktsegment, c_acctbal + 1 AS c_acctbal, c_nationkey, 2 AS n_versions FROM customer WHERE c_acctbal < 0
""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("sha256", F.sha2(F.col("c_custkey").cast("string"), 256))

    def versioned(df, no):
        return df.withColumn("version", F.lit(no)).withColumn("provenance", F.array(F.struct(F.lit(f"v{no}").alias("source"), F.lit("n").alias("name"))))

    fresh = versioned(rows.filter("c_acctbal < 0").withColumn("c_mktsegment", F.lit("UPDATED")).withColumn("c_acctbal", F.col("c_acctbal") + 1), 2)
    done = merge.upsert(versioned(rows, 1), fresh)
    return done.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey", F.size("provenance").alias("n_versions"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def registry_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha256"), "o_custkey")
    gone = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("sha256"))
    return merge.delete(stored, gone).select(F.col("sha256").alias("o_orderkey"), "o_custkey")


@query("""
SELECT DISTINCT l_suppkey AS s_suppkey, 'new' AS state FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_suppkey")
    fresh = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    return merge.insert_absent(stored, fresh, ["s_suppkey"]).select("s_suppkey", F.lit("new").alias("state"))


@query("""
WITH v AS (SELECT DISTINCT event_type AS raw, replace(lower(event_type), ' ', '_') AS label FROM events
           UNION SELECT DISTINCT p_type, replace(lower(p_type), ' ', '_') FROM part)
SELECT sha256('{"label":"' || label || '","value_type":"categorical"}') AS sha256, label,
       array_to_string(list_sort(list(DISTINCT raw)), '|') AS raw_values FROM v GROUP BY label
""")
def value_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("raw")).union(table(spark, sf_dir, "part").select("p_type"))
    return merge.value_concepts(raw).withColumn("raw_values", F.array_join("raw_values", "|"))


@query("""
SELECT r_name AS source, r_name AS class, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS properties
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def schema_from_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.select(F.col("r_name").alias("source"), F.col("r_name").alias("class"), F.col("n_name").alias("name"))
    return merge.schemas_by_class(rows).withColumn("properties", F.array_join("properties", ","))


@query("""
SELECT doc_id, lang, source FROM (
  SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source, text ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""")
def extraction_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return merge.keep_first(rows, ["lang", "source", "text"], ["doc_id"]).select("doc_id", "lang", "source")


@query("""
WITH s AS (SELECT l_partkey, l_returnflag FROM lineitem GROUP BY ALL)
SELECT l_partkey AS part, count(*)::INT AS n_sources, array_to_string(list_sort(list(l_returnflag)), ',') AS sources FROM s GROUP BY 1
""")
def multi_source_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").distinct()
    rows = distinct.groupBy(F.col("l_partkey").alias("sha256")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("source"))).alias("provenance"))
    return merge.multi_source(rows).select(F.col("sha256").alias("part"), "n_sources", F.array_join("sources", ",").alias("sources"))


@query("""
SELECT 'PART_' || p_size AS uri, count(*)::BIGINT AS n_entities, min(p_partkey)::BIGINT AS first_entity FROM part WHERE p_size % 2 = 0 GROUP BY 1
""")
def ontology_reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("PART_"), F.col("p_size").cast("string"))).alias("uri"), F.lit("elements").alias("entity_type"), F.col("p_partkey").alias("sha256"))
    return merge.index_by_term(rows).select("uri", F.size("entities").cast("bigint").alias("n_entities"), F.array_min(F.transform("entities", lambda e: e["sha256"])).alias("first_entity"))


# --- browsing


_PAGE = "SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE '%{t}%' AND {after} ORDER BY p_name {way} NULLS LAST, p_partkey LIMIT 11"


@query(_PAGE.format(t="MALL", after="(p_name > 'm' OR (p_name = 'm' AND p_partkey > 5))", way="ASC"))
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").filter(browse.says("mall", "p_type"))
    return browse.page(rows, "p_name", "p_partkey", 10, ("m", 5)).select("p_partkey", "p_name", "p_type")


@query(_PAGE.format(t="MALL", after="(p_name < 'm' OR (p_name = 'm' AND p_partkey > 5))", way="DESC"))
def browse_page_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").filter(browse.says("mall", "p_type"))
    return browse.page(rows, "p_name", "p_partkey", 10, ("m", 5), descending=True).select("p_partkey", "p_name", "p_type")


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def browse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""
WITH p AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_contains(s, 'R') AS exact, len(list_filter(s, lambda x: starts_with(x, 'N'))) > 0 AS prefixed FROM p
""")
def source_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct(F.col("l_returnflag").alias("source"))).alias("provenance"))
    return rows.select("l_orderkey", browse.of_source("R").alias("exact"), browse.of_source_prefix("N").alias("prefixed"))


@query("""
SELECT s_suppkey, count(*)::BIGINT AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey
WHERE l_partkey = 7 GROUP BY 1
""")
def schemas_using_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("properties"))
    using = made.filter(browse.uses("properties", "7"))
    return using.select(F.col("l_suppkey").alias("s_suppkey"), F.size(F.filter("properties", lambda p: p == "7")).cast("bigint").alias("n"))


# --- inference and parsing


def _docs(spark, sf_dir):
    extra = F.concat(F.col("text"), F.lit(" at least "), (F.col("doc_id") % 7).cast("string"), F.lit(" capped at "), (F.col("doc_id") % 90).cast("string"), F.lit(".5"))
    tail = F.when(F.col("doc_id") % 5 == 0, " age in years").when(F.col("doc_id") % 5 == 1, " ISO 8601 years").when(F.col("doc_id") % 5 == 2, " weight in kilograms").when(F.col("doc_id") % 5 == 3, " a UUID, 3 mV").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(extra, tail).alias("text"))


_DOCS = """WITH d AS (SELECT doc_id, text || ' at least ' || (doc_id % 7) || ' capped at ' || (doc_id % 90) || '.5' ||
  CASE doc_id % 5 WHEN 0 THEN ' age in years' WHEN 1 THEN ' ISO 8601 years' WHEN 2 THEN ' weight in kilograms' WHEN 3 THEN ' a UUID, 3 mV' ELSE '' END AS text FROM documents)
"""


def _cases(patterns: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join("WHEN regexp_matches(text, '{}') THEN '{}'".format(p.replace("'", "''"), v.replace("'", "''")) for p, v in patterns) + " END"


@query(_DOCS + f"SELECT doc_id, {_cases([(infer.ISO_8601, 'ISO8601'), *infer.UNIT_PATTERNS])} AS unit FROM d")
def infer_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", infer.unit(F.col("text")).alias("unit"))


@query(_DOCS + f"SELECT doc_id, {_cases(infer.FORMATS)} AS pattern FROM d")
def infer_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", infer.pattern(F.col("text")).alias("pattern"))


@query(_DOCS + f"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '{infer.LEAST}', 1), '') AS DOUBLE) AS least, TRY_CAST(nullif(regexp_extract(text, '{infer.MOST}', 1), '') AS DOUBLE) AS most FROM d")
def infer_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    least, most = infer.bounds(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", least.alias("least"), most.alias("most"))


@query("""
SELECT domain, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN p_size % 3 = 0 THEN 'categorical' WHEN p_size % 4 = 0 THEN 'text' WHEN p_size % 4 IN (1, 2) THEN 'numeric' ELSE 'boolean' END AS domain FROM part) GROUP BY 1
""")
def value_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(k) for k in ("string", "integer", "float", "boolean"))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(infer.value_domain(kind, F.col("p_size") % 3 == 0).alias("domain")).agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT 'p_partkey' AS "column", p_partkey::VARCHAR AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part
           UNION ALL SELECT 'p_retailprice', p_retailprice::VARCHAR FROM part UNION ALL SELECT 'p_flag', (p_size % 2)::VARCHAR FROM part UNION ALL SELECT 'p_name', p_name FROM part),
     a AS (SELECT "column", bool_and(regexp_matches(v, '^[0-9]+$')) AS i, bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) AS f, count(*) AS n, count(DISTINCT v) AS k, array_to_string(list_sort(list(DISTINCT v)), '|') AS c FROM l GROUP BY 1)
SELECT "column", CASE WHEN i THEN 'integer' WHEN f THEN 'float' ELSE 'string' END AS data_type, n::BIGINT AS n_told,
       CASE WHEN NOT i AND NOT f AND k BETWEEN 2 AND 30 THEN c END AS categories FROM a
""")
def column_type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_brand", F.col("p_retailprice").cast("string").alias("p_retailprice"), (F.col("p_size") % 2).cast("string").alias("p_flag"), "p_name")
    return dictionaries.profile(rows).withColumn("categories", F.array_join("categories", "|"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand || ';' || p_type WHEN 1 THEN p_brand || ';' || p_size WHEN 2 THEN 'a b;' || p_brand ELSE p_type END AS choices FROM part
""")
def choice_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_size") % 4
    raw = F.when(m == 0, F.concat(F.lit("1, "), "p_brand", F.lit(" | 2, "), "p_type")).when(m == 1, F.concat_ws(" ; ", "p_brand", F.col("p_size").cast("string"), F.lit(""))).when(m == 2, F.concat(F.lit("a b, "), "p_brand")).otherwise(F.concat(F.lit(" "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parse.choices(raw), ";").alias("choices"))


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 1 THEN NULL ELSE round(s_acctbal, 2) END AS least, CASE WHEN s_nationkey % 3 = 2 THEN NULL ELSE s_nationkey::DOUBLE END AS most FROM supplier
""")
def range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("s_nationkey") % 3
    a, b = F.round("s_acctbal", 2).cast("decimal(18,2)").cast("string"), F.col("s_nationkey").cast("string")
    raw = F.when(m == 0, F.concat(a, F.lit(" :: "), b)).when(m == 1, F.concat(F.lit(":: "), b)).otherwise(F.concat(a, F.lit("::")))
    least, most = parse.value_range(raw)
    return table(spark, sf_dir, "supplier").select("s_suppkey", least.alias("least"), most.alias("most"))


@query("""
SELECT p_partkey, p_size || '=' || p_brand || ';-1=' || p_type AS options FROM part
""")
def notes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" = "), "p_brand", F.lit(" ; no code; -1="), "p_type", F.lit(" ;"))
    got = F.transform(parse.notes(raw), lambda o: F.concat_ws("=", o["value"], o["label"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(got, ";").alias("options"))


@query("""
WITH u AS (SELECT DISTINCT p_size AS k, CASE p_size % 5 WHEN 0 THEN ' Years' WHEN 1 THEN 'kg' WHEN 2 THEN 'KHZ' WHEN 3 THEN 'Furlong' ELSE 'nothing' END AS unit FROM part)
SELECT k, unit, CASE k % 5 WHEN 0 THEN 'http://qudt.org/vocab/unit/YR' WHEN 1 THEN 'http://qudt.org/vocab/unit/KiloGM' WHEN 2 THEN 'http://qudt.org/vocab/unit/KiloHZ' WHEN 3 THEN 'http://qudt.org/vocab/unit/FUR' END AS unit_uri FROM u
""")
def unit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in (" Years", "kg", "KHZ", "Furlong", "nothing")))
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("k")).distinct().withColumn("unit", F.element_at(names, F.col("k") % 5 + 1))
    vocabulary = spark.sql("select 'http://qudt.org/vocab/unit/FUR' as uri, 'fur' as symbol, 'furlong' as label, 201.168 as multiplier")
    return units.resolve(rows, vocabulary)


# --- vectors


_VECTORS = """WITH q AS (SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 25 = 0),
     s AS (SELECT query, vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM q, embeddings e WHERE e.vec_id <> query),
     r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s)
"""


def _vector_ranks(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    near = vec.top_k(asked, vectors.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return near.filter("query <> item").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@query(_VECTORS + "SELECT query, item, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_ranks(spark, sf_dir, 5).select("query", "item", F.round("score", 6).alias("score"), "rank")


@query(_VECTORS + """, t AS (SELECT * FROM r WHERE rank <= 20),
     g AS (SELECT *, coalesce(lag(score) OVER (PARTITION BY query ORDER BY rank) - score > 0.15, false) OR score < 0.2 AS stop FROM t),
     c AS (SELECT *, sum(stop::INT) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS stops FROM g)
SELECT query, item, round(score, 6) AS score, rank::INT AS rank,
       CASE WHEN score >= 0.95 THEN 'skos:exactMatch' WHEN score >= 0.8 THEN 'skos:closeMatch' WHEN score >= 0.5 THEN 'skos:relatedMatch' ELSE 'skos:noMatch' END AS relation
FROM c WHERE stops = 0 AND rank <= 10
""")
def vector_gap_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = vec.gap_cutoff(_vector_ranks(spark, sf_dir, 20), 0.2)
    return kept.select("query", "item", F.round("score", 6).alias("score"), "rank", "relation")


@query(_VECTORS + """, b AS (SELECT query, max(score) AS a, min(score) AS z FROM r WHERE rank <= 2 GROUP BY 1)
SELECT query AS entity_ref, 'needs_review' AS flag_type, 'unsure_score' AS reason FROM b WHERE a >= 0.7 AND a < 0.95
UNION ALL SELECT query, 'needs_review', 'close_candidates' FROM b WHERE a - z < 0.05
""")
def curation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _vector_ranks(spark, sf_dir, 2).groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    return curate.annotation_flags(two.withColumnRenamed("query", "id"))


# --- alignment and transforms


def _elements(spark, sf_dir):
    """Parts as elements of their type, with a range of ordered quantities, the words of their names, and a term by size."""
    ranges = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_quantity").alias("min_value"), F.max("l_quantity").alias("max_value"))
    parts = table(spark, sf_dir, "part").join(ranges, F.col("p_partkey") == F.col("l_partkey"), "left")
    nothing = F.lit(None)
    return parts.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("data_type"), F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("term_uri"), "min_value", "max_value",
        F.split("p_name", " ").alias("choices"), nothing.cast("array<float>").alias("vector"), nothing.cast("array<string>").alias("hints"),
    )


@query("""
WITH e AS (SELECT p_partkey AS id, p_type AS t, p_size AS s, list_distinct(str_split(p_name, ' ')) AS c, a, z
           FROM part LEFT JOIN (SELECT l_partkey, min(l_quantity) AS a, max(l_quantity) AS z FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
     p AS (SELECT x.id AS a_id, y.id AS b_id, x.a AS xa, x.z AS xz, y.a AS ya, y.z AS yz,
                  CASE WHEN x.a IS NULL OR y.a IS NULL OR x.z < y.a OR y.z < x.a THEN 0.0 WHEN greatest(x.z, y.z) = least(x.a, y.a) THEN 1.0
                       ELSE greatest(least(x.z, y.z) - greatest(x.a, y.a), 0) / (greatest(x.z, y.z) - least(x.a, y.a)) END AS r,
                  len(list_intersect(x.c, y.c)) / len(list_distinct(list_concat(x.c, y.c))) AS j
           FROM e x JOIN e y ON x.t = y.t AND x.s = y.s AND x.id < y.id),
     w AS (SELECT *, round(0.4 + 0.15 * r + 0.15 * j, 4) AS score FROM p)
SELECT a_id, b_id, score, CASE WHEN xa <= ya AND xz >= yz THEN 'skos:broadMatch' WHEN ya <= xa AND yz >= xz THEN 'skos:narrowMatch' WHEN score >= 0.5 THEN 'skos:relatedMatch' ELSE 'none' END AS relation
FROM w WHERE score >= 0.5
""")
def alias_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.candidates(_elements(spark, sf_dir)).select("a_id", "b_id", "score", "relation")


@query("""
WITH RECURSIVE e AS (SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey <> y.p_partkey),
     r(node, pos) AS (SELECT a, a FROM e UNION SELECT node, b FROM r JOIN e ON pos = a)
SELECT component, count(*)::BIGINT AS n_members FROM (SELECT node, least(node, min(pos)) AS component FROM r GROUP BY node) GROUP BY 1
""")
def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches are an equivalence here, so each part is linked with the smallest of its brand and size, which joins the same parts as all pairs do."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    first = parts.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("a_id"))
    pairs = parts.withColumnRenamed("p_partkey", "b_id").join(first, ["p_brand", "p_size"]).filter("a_id < b_id").withColumn("relation", F.lit("skos:exactMatch"))
    return align.groups(pairs).select("component", F.size("members").cast("bigint").alias("n_members"))


@query("""
WITH e AS (SELECT doc_id AS id, text AS label, source, doc_id % 3 = 0 AS annotated FROM documents),
     g AS (SELECT label, count(DISTINCT source) AS k, min(id) FILTER (WHERE annotated) AS donor, FROM e GROUP BY 1)
SELECT e.id, g.donor, d.source AS donor_source FROM e JOIN g USING (label) JOIN e d ON d.id = g.donor WHERE k >= 2 AND NOT e.annotated
""")
def cross_source_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("label"), "source", (F.col("doc_id") % 3 == 0).alias("annotated"), F.col("doc_id").alias("ord"))
    return align.transfer(rows).select("id", "donor", "donor_source")


@query("SELECT 'T' || p_size AS term_uri, count(DISTINCT p_brand)::BIGINT AS n_sources FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("term_uri"), F.col("p_brand").alias("source"))
    return align.shared_terms(rows)


@query("""
WITH a AS (SELECT p_brand AS k, string_agg(p_partkey, ',' ORDER BY p_partkey) AS members FROM part WHERE p_size <= 25 GROUP BY 1),
     b AS (SELECT p_brand AS k, string_agg(p_partkey, ',' ORDER BY p_partkey) AS members FROM part WHERE p_size <= 25 OR p_brand LIKE '%1' GROUP BY 1)
SELECT members, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'unchanged' WHEN a.k IS NOT NULL THEN 'new' ELSE 'dissolved' END AS state FROM a FULL JOIN b USING (members)
""")
def alignment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def grouped(rows):
        return rows.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("members"))

    parts = table(spark, sf_dir, "part")
    found = align.diff(grouped(parts.filter("p_size <= 25")), grouped(parts.filter("p_size <= 25 or p_brand like '%1'")))
    return found.withColumn("members", F.array_join("members", ","))


@query("""
WITH e AS (SELECT p_partkey AS id, p_brand AS source, 'T' || (p_partkey % 400) AS term, lower(p_name) AS name,
                  CASE p_size % 4 WHEN 0 THEN 'float' WHEN 1 THEN 'integer' WHEN 2 THEN 'string' ELSE 'object' END AS t,
                  CASE p_size % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'ISO8601' END AS u FROM part),
     p AS (SELECT a_id, b_id, min(s) AS strategy FROM (
             SELECT x.id AS a_id, y.id AS b_id, 1 AS s FROM e x JOIN e y ON x.term = y.term AND x.id < y.id
             UNION ALL SELECT x.id, y.id, 2 FROM e x JOIN e y ON x.name = y.name AND x.source <> y.source AND x.id < y.id) GROUP BY ALL),
     f AS (SELECT a_id, b_id, strategy, CASE WHEN x.t = y.t AND x.u = y.u THEN 'identity'
             WHEN x.t = y.t AND ((x.u = 'year' AND y.u = 'month') OR (x.u = 'month' AND y.u = 'year')) THEN 'unit_conversion'
             WHEN x.t IN ('integer', 'float') AND y.t = 'string' AND y.u = 'ISO8601' THEN 'type_conversion'
             WHEN x.t = 'string' AND y.t IN ('integer', 'float') AND x.u = 'ISO8601' THEN 'type_conversion'
             WHEN (x.t = 'object') <> (y.t = 'object') THEN 'structural' WHEN x.t <> y.t THEN 'unknown' END AS function_type,
             CASE WHEN x.t = y.t AND x.u = 'year' AND y.u = 'month' THEN 12.0 WHEN x.t = y.t AND x.u = 'month' AND y.u = 'year' THEN 1.0 / 12.0 END AS factor
           FROM p JOIN e x ON x.id = a_id JOIN e y ON y.id = b_id)
SELECT a_id, b_id, strategy, function_type, round(factor, 6)::DOUBLE AS factor FROM f WHERE function_type IS NOT NULL
""")
def transform_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    types, unit_names = F.array(*(F.lit(x) for x in ("float", "integer", "string", "object"))), F.array(*(F.lit(x) for x in ("year", "month", "ISO8601")))
    rows = table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_brand").alias("source"), F.concat(F.lit("T"), (key % 400).cast("string")).alias("term_uri"), F.col("p_name").alias("name"), F.sha2(key.cast("string"), 256).alias("sha256"),
        F.element_at(types, size % 4 + 1).alias("data_type"), F.element_at(unit_names, size % 3 + 1).alias("unit"), F.lit(None).cast("string").alias("value_domain"),
        F.lit(None).cast("array<string>").alias("choices"), F.lit(None).cast("string").alias("structural_type"),
    )
    return transforms.generate(rows).select("a_id", "b_id", "strategy", "function.function_type", F.round("function.factor", 6).alias("factor"))


@query("""
WITH m AS (SELECT p_brand, p_type, max_by(p_partkey, p_partkey) AS k FROM part GROUP BY 1, 2), n AS (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY 1),
     s AS (SELECT DISTINCT p_brand FROM part), r AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS pos FROM s, (SELECT DISTINCT p_type FROM part))
SELECT r.p_brand AS schema_id, string_agg(sha256(coalesce(m.k, n.k)::VARCHAR), ',' ORDER BY pos) || ',unknown' AS properties FROM r LEFT JOIN m USING (p_brand, p_type) LEFT JOIN n ON n.p_type = r.p_type GROUP BY 1
""")
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    known = parts.select(F.col("p_brand").alias("class"), F.col("p_type").alias("name"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"), F.col("p_partkey").alias("ord"))
    kinds = parts.select("p_type").distinct().agg(F.array_sort(F.collect_list("p_type")).alias("kinds"))
    schemas = parts.select(F.col("p_brand").alias("schema_id"), F.col("p_brand").alias("class")).distinct().crossJoin(kinds).withColumn("properties", F.concat("kinds", F.array(F.lit("unknown"))))
    return resolve.properties(schemas.drop("kinds"), known).withColumn("properties", F.array_join("properties", ","))


# --- ontology, versions, quality, search


@query("""
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region
           UNION ALL SELECT 'world', 'r0' UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
     a(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e WHERE starts_with(child, 'c') UNION ALL SELECT node, parent, depth + 1 FROM a JOIN e ON ancestor = child WHERE depth < 4)
SELECT node, ancestor, min(depth)::INT AS depth FROM a GROUP BY 1, 2
""")
def ontology_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(name, child, parent):
        return table(spark, sf_dir, name).select(F.concat(F.lit(child[0]), F.col(child[1]).cast("string")).alias("child"), parent.alias("parent"))

    def text(c, letter):
        return F.concat(F.lit(letter), F.col(c).cast("string"))

    edges = named("nation", ("n", "n_nationkey"), text("n_regionkey", "r")).union(named("region", ("r", "r_regionkey"), F.lit("world"))).union(spark.sql("select 'world', 'r0'")).union(named("customer", ("c", "c_custkey"), text("c_nationkey", "n")))
    start = table(spark, sf_dir, "customer").select(text("c_custkey", "c").alias("node"))
    return graph.ancestors(edges, start, 4)


@query("""
WITH t AS (SELECT n_regionkey AS uri, n_name AS label FROM nation)
SELECT uri, (list(label ORDER BY length(label) DESC, label DESC))[1] AS label, (count(DISTINCT label) - 1)::INT AS n_synonyms FROM t GROUP BY 1
""")
def term_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("uri"), F.col("n_name").alias("label"), F.array().cast("array<string>").alias("synonyms"), F.lit(False).alias("deprecated"))
    return ontology.merge_terms(rows).select("uri", "label", F.size("synonyms").alias("n_synonyms"))


@query("""
WITH w AS (SELECT DISTINCT p_size AS k, p_name AS n FROM part UNION SELECT DISTINCT p_size, split_part(p_name, ' ', 1) FROM part WHERE p_size % 2 = 0)
SELECT k, count(*)::INT AS n_kept FROM w x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE x.k = y.k AND starts_with(lower(y.n), lower(x.n) || ' ')) GROUP BY 1
""")
def species_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    names = parts.select("p_size", "p_name").union(parts.filter("p_size % 2 = 0").select("p_size", F.split("p_name", " ")[0])).distinct()
    rows = names.groupBy(F.col("p_size").alias("k")).agg(F.collect_list(F.struct(F.lit("http://x/NCBITaxon_1").alias("term_uri"), F.col("p_name").alias("term_label"))).alias("anns"))
    return rows.select("k", F.size(vec.species_over_genus(F.col("anns"))).alias("n_kept"))


@query("""
WITH a AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderdate < DATE '1995-01-01' GROUP BY 1), b AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderdate < DATE '1997-01-01' GROUP BY 1)
SELECT o_custkey, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'modified' END AS state FROM a FULL JOIN b USING (o_custkey) WHERE a.v IS DISTINCT FROM b.v
""")
def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    def until(day):
        return table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < day).groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))

    return quality.delta(until("1995-01-01"), until("1997-01-01"), "o_custkey", "v")


@query("""
WITH a AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT k, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)::BIGINT AS added, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)::BIGINT AS removed FROM a FULL JOIN b USING (k)
""")
def count_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(status):
        return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))

    return quality.count_delta(of("O"), of("F"), "k")


@query("""
SELECT l_orderkey || '/' || l_linenumber AS id, 'small_discount' AS rule FROM lineitem WHERE NOT (l_discount <= 0.05)
UNION ALL SELECT l_orderkey || '/' || l_linenumber, 'known_flag' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT l_orderkey || '/' || l_linenumber, 'few' FROM lineitem WHERE l_quantity >= 40
""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return quality.violations(rows, {"small_discount": F.col("l_discount") <= 0.05, "known_flag": F.col("l_returnflag").isin("A", "N"), "few": F.col("l_quantity") < 40})


@query("""
WITH v AS (SELECT p_partkey AS old, CASE WHEN p_size % 4 = 0 THEN p_partkey WHEN p_size % 4 = 1 THEN p_partkey + 1 ELSE -p_partkey END AS new FROM part)
SELECT old, new, CASE WHEN old = new THEN 'no_change' WHEN new IN (SELECT p_partkey FROM part) THEN 'exists' ELSE 'superseded' END AS outcome FROM v
""")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    m = F.col("p_size") % 4
    changes = parts.select(key.alias("sha256"), F.when(m == 0, key).when(m == 1, key + 1).otherwise(-key).alias("new_sha256"))
    rows = parts.select(key.alias("sha256"))
    return curate.new_versions(rows, changes, rows)


@query("""
WITH l AS (SELECT doc_id AS sha256, source AS name, 0.8 AS score FROM documents WHERE contains(lower(text), 'and then')),
     s AS (SELECT vec_id AS sha256, 'v' || label AS name, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings),
     t AS (SELECT * FROM s ORDER BY score DESC, sha256 LIMIT 40)
SELECT sha256, round(max(score), 6) AS score, min(name) AS name FROM (SELECT * FROM l UNION ALL SELECT * FROM t) GROUP BY 1 ORDER BY max(score) DESC, lower(min(name)), sha256 LIMIT 50
""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sha256"), F.lit("value").alias("kind"), F.col("source").alias("name"), "text")
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    near = vec.top_k(asked, vectors.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), 40)
    named = near.join(vectors.select(F.col("vec_id").alias("item"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("name")), "item")
    found = search.hybrid(search.lexical(docs, "and then"), named.select(F.col("item").alias("sha256"), "name", "score"), 50)
    return found.select("sha256", F.round("score", 6).alias("score"), "name")


@query("""
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v, p_type AS phrase FROM embeddings LEFT JOIN part ON p_partkey = vec_id + 1 WHERE vec_id % 100 = 0),
     l AS (SELECT query, p_partkey AS sha256, p_name AS name, CASE p_size % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 ELSE 0.0 END::DOUBLE AS score
           FROM part JOIN q ON contains(lower(p_name || ' ' || p_type), lower(phrase))),
     s AS (SELECT query, vec_id AS sha256, 'v' || label AS name, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q),
     t AS (SELECT query, sha256, name, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, sha256) <= 40),
     b AS (SELECT query, sha256, max(score) AS score, min(name) AS name FROM (SELECT * FROM l UNION ALL SELECT * FROM t) GROUP BY 1, 2)
SELECT query, sha256, name, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, lower(name), sha256)::INT AS rank FROM b
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, lower(name), sha256) <= 50
""")
def hybrid_search_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, vectors = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings")
    kind = F.get(F.array(*map(F.lit, (*search.BASE, "other"))), F.col("p_size") % 5)
    found = parts.select(F.col("p_partkey").alias("sha256"), kind.alias("kind"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    phrases = asked.join(parts.select((F.col("p_partkey") - 1).alias("query"), F.col("p_type").alias("phrase")), "query")
    near = vec.top_k(asked, vectors.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), 40)
    named = near.join(vectors.select(F.col("vec_id").alias("item"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("name")), "item")
    semantic = graph.materialised(named.select("query", F.col("item").alias("sha256"), "name", F.round("score", 6).alias("score")), "near")
    return search.hybrid_each(search.lexical_first(found, phrases, semantic, 50, 40), semantic, 50)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(table(spark, sf_dir, "events")).select("hour", "event_type", "n", F.round("total", 4).alias("total"))


@query()
def difflib_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("next"))
    return parts.filter("next is not null").select("p_partkey", F.round(similarity.name_ratio(F.col("p_name"), F.col("next")), 6).alias("ratio"))
