"""Queries on joins, indexes and tables of their own making, and on the steps of the registry pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions import english, unit_algebra
from regolith.operators import transforms, vector_join
from regolith.operators.graph import materialised, shared_dir
from regolith.operators.lexical_index import LexicalIndex
from regolith.operators.table_log import TableLog
from regolith.operators.vector_index import VectorIndex
from regolith.sources.documents import entities
from regolith.streaming.windows import sessions

from . import pipeline
from .registry_queries import query, table


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3
""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of one label from a cosine on."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("group"))
    return vector_join.similar_pairs(rows, 0.3).select("a_id", "b_id", F.round("score", 6).alias("score"))


@query("""
WITH e AS (SELECT vec_id AS id, 's' || label AS source, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 3 = 0 THEN 'kg' ELSE 'g' END AS unit FROM embeddings)
SELECT a.id AS a_id, b.id AS b_id, 3 AS strategy, CASE WHEN a.unit = b.unit THEN 'identity' ELSE 'unit_conversion' END AS function_type, CASE WHEN a.unit = b.unit THEN NULL WHEN a.unit = 'kg' THEN 1000.0 ELSE 0.001 END::DOUBLE AS factor
FROM e a JOIN e b ON a.id < b.id AND a.source <> b.source AND list_cosine_similarity(a.v, b.v) >= 0.35
""")
def transforms_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms between elements of different sources whose vectors are alike."""
    nothing = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("s"), "label").alias("source"), nothing.alias("term_uri"), F.concat(F.lit("n"), "vec_id").alias("name"), F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"),
        F.lit("float").alias("data_type"), F.when(F.col("vec_id") % 3 == 0, "kg").otherwise("g").alias("unit"), F.lit("").alias("value_domain"), F.array().cast("array<string>").alias("choices"), nothing.alias("structural_type"), F.col("embedding").alias("vector"),
    )
    return transforms.generate(rows, 0.35, algebra=True).select("a_id", "b_id", "strategy", "function.function_type", F.round("function.factor", 6).alias("factor"))


@query("""
SELECT query, item, round(score, 6) AS score, rank::INT AS rank FROM (
  SELECT q.vec_id AS query, e.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e) WHERE rank <= 4
""")
def index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the vectors are indexed, the rest appended; every vector asks the opened index for its nearest."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    path = scratch(spark, "vector-index")
    VectorIndex.build(vectors.filter("item % 2 = 0"), path, "given")
    index = VectorIndex.open(spark, path, "given")
    index.append(vectors.filter("item % 2 = 1"))
    found = index.search(vectors.withColumnRenamed("item", "query"), 4)
    return found.select("query", "item", F.round("score", 6).alias("score"), "rank")


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*'))"


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*') AS l FROM documents),
     q AS (SELECT doc_id AS query, list_distinct([l[len(l)], l[len(l) // 2 + 1]]) AS t FROM d WHERE doc_id % 100 = 0 AND len(w) > 0)
SELECT query, doc_id AS id FROM q JOIN d ON list_has_all(w, t)
""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts are indexed, a part of them again after a deletion; every 100th text asks for its last and its middle word together."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    path = scratch(spark, "lexical-index")
    index = LexicalIndex.build(docs.filter("id % 3 > 0").withColumn("text", F.when(F.col("id") % 3 == 1, "what will be replaced").otherwise(F.col("text"))), path, "words")
    index.delete(docs.filter("id % 6 = 1").select("id"))
    index.upsert(docs.filter("id % 3 < 2"))
    words = english.words(F.col("text"))
    asked = docs.filter("id % 100 = 0").select(F.col("id").alias("query"), F.concat_ws(" ", F.try_element_at(words, F.lit(-1)), F.get(words, F.floor(F.size(words) / 2).cast("int"))).alias("phrase"))
    return LexicalIndex.open(spark, path, "words").search(asked)


_UNIT_SQL = {"kg": (1.0, 1), "mg": (1e-6, 1), "g/mL": (1e3, 2), "kg.m-3": (1.0, 2), "ug/L": (1e-6, 2), "km/h": (1 / 3.6, 3), "cm s-1": (0.01, 3), "N.m": (1.0, 4), "kJ": (1e3, 4), "no unit": (None, None)}


@query(f"""
WITH u(i, unit, scale, dims) AS (VALUES {", ".join(f"({i}, '{u}', {'NULL' if s is None else s}::DOUBLE, {'NULL' if d is None else d})" for i, (u, (s, d)) in enumerate(_UNIT_SQL.items()))}),
     p AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, (l_partkey + l_linenumber) % 10 AS a, l_suppkey % 10 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(x.scale / y.scale, 12) AS factor, round(v * x.scale / y.scale, 6) AS value
FROM p JOIN u x ON x.i = a JOIN u y ON y.i = b AND x.dims = y.dims
""")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in one compound unit turned into another, where dimensions agree; each distinct unit is read once."""
    names = F.array(*(F.lit(u) for u in _UNIT_SQL))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.get(names, ((F.col("l_partkey") + F.col("l_linenumber")) % 10).cast("int")).alias("a"), F.get(names, (F.col("l_suppkey") % 10).cast("int")).alias("b"))
    each = lines.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    read = materialised(each.select("u", unit_algebra.parsed(F.col("u")).alias("p")), "units")  # written, or Spark reads the units of every line again to filter by them
    known = read.select(F.col("u").alias("a"), F.col("p").alias("pa")).join(read.select(F.col("u").alias("b"), F.col("p").alias("pb")), unit_algebra.compatible(F.col("pa"), F.col("pb")))
    return lines.join(known, ["a", "b"]).select("l_orderkey", "l_linenumber", F.round(unit_algebra.factor(F.col("pa"), F.col("pb")), 12).alias("factor"), F.round(unit_algebra.converted(F.col("l_quantity"), F.col("pa"), F.col("pb")), 6).alias("value"))


@query("""
WITH c AS (SELECT sha256(c_custkey::VARCHAR) AS sha256, c_name, c_acctbal, c_custkey FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'UPDATED' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS n_sources, 'now' AS state FROM c WHERE c_custkey % 11 > 0
UNION ALL SELECT c_custkey, c_name, 1, 'first' FROM c
""")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after two batches, one of them delivered again, a deletion and a compaction; and as it was after the first batch."""
    rows = table(spark, sf_dir, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"), "c_custkey", F.col("c_name").alias("name"), F.lit(1).alias("version"), F.array(F.struct(F.lit("a").alias("source"), F.lit("n").alias("name"))).alias("provenance"))
    changed = rows.filter("c_custkey % 7 = 0").withColumn("name", F.lit("UPDATED")).withColumn("version", F.lit(2)).withColumn("provenance", F.array(F.struct(F.lit("b").alias("source"), F.lit("n").alias("name"))))
    log = TableLog.create(spark, scratch(spark, "table-log"), rows.schema, 8)
    first = log.merge(rows, "one")
    log.merge(changed, "two")
    log.merge(changed.withColumn("version", F.lit(3)).withColumn("name", F.lit("NEVER")), "two")
    log.delete(rows.filter("c_custkey % 11 = 0").select("sha256"))
    log.compact()
    told = ("c_custkey", "name", F.size("provenance").alias("n_sources"))
    return log.read().select(*told, F.lit("now").alias("state")).unionByName(log.read(first).select(*told, F.lit("first").alias("state")))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
     s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS begins, max(ts)::TIMESTAMP + INTERVAL 30 MINUTE AS ends, count(*)::BIGINT AS n FROM s GROUP BY user_id, no
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("begins"), F.col("end").cast("timestamp_ntz").alias("ends"), "n")


# --- the pipeline, step by step

SOURCES = ["s0", "s1", "s2", "s3"]


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as extracted elements: their type is the name, every second size says its term, every fifth source is not on the list."""
    size, none = F.col("p_size"), F.lit(None)
    about = F.when(size % 2 == 0, F.concat(F.lit("told by http://purl.obolibrary.org/obo/PATO_"), F.lpad(size.cast("string"), 7, "0"))).otherwise("")
    kind = F.when(size % 3 == 0, "integer").when(size % 3 == 1, "string").otherwise("float")
    return entities(
        table(spark, sf_dir, "part"), entity_type=pipeline.ELEMENT, source=F.concat(F.lit("s"), (F.col("p_partkey") % 5).cast("string")), name=F.col("p_type"), description=about, data_type=kind,
        unit=F.when(size % 4 == 0, "kg"), file=F.lpad(F.col("p_partkey").cast("string"), 10, "0"), **{"class": F.col("p_brand")}, options=none,
    )


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(pipeline.committed(pipeline.enriched(pipeline.staged(_extracted(spark, sf_dir))), SOURCES), "registry")


_STAGED_SQL = """
WITH p AS (SELECT 's' || (p_partkey % 5) AS source, p_brand AS class, p_type AS name, p_size AS n, lpad(p_partkey::VARCHAR, 10, '0') AS file,
                  CASE WHEN p_size % 2 = 0 THEN 'http://purl.obolibrary.org/obo/PATO_' || lpad(p_size::VARCHAR, 7, '0') END AS term,
                  CASE p_size % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'string' ELSE 'float' END AS data_type, CASE WHEN p_size % 4 = 0 THEN 'kg' END AS unit FROM part),
     staged AS (SELECT *, CASE WHEN unit = 'kg' THEN 'http://qudt.org/vocab/unit/KiloGM' END AS unit_uri FROM p QUALIFY row_number() OVER (PARTITION BY source, class, name ORDER BY file) = 1),
     hashed AS (SELECT *, sha256('{' || CASE WHEN term IS NULL THEN '"_attribute":"' || name || '","_class":"' || class || '",' ELSE '"_primary_ontology_uri":"' || term || '",' END
                    || '"data_type":"' || data_type || '"' || CASE WHEN unit IS NULL THEN '' ELSE ',"unit":"' || unit_uri || '"' END || '}') AS sha256 FROM staged),
     listed AS (SELECT * FROM hashed WHERE source <> 's4'),
     registry AS (SELECT sha256, count(*) AS n_rows, any_value(term) AS term, any_value(data_type) AS data_type, any_value(unit) AS unit, count(DISTINCT source || '/' || name) AS n_provenance,
                         arg_min(name, file || source || class || name) AS name, arg_min(source, file || source || class || name) AS source FROM listed GROUP BY sha256)
"""


@query(_STAGED_SQL + "SELECT source, class, name, file, data_type, unit, unit_uri, term AS term_uri FROM staged")
def pipeline_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pipeline.enriched(pipeline.staged(_extracted(spark, sf_dir)))
    return done.select("source", "class", "name", "file", "data_type", "unit", "unit_uri", F.col("annotations")[0]["term_uri"].alias("term_uri"))


@query(_STAGED_SQL + "SELECT sha256, n_rows::BIGINT AS n_rows, n_provenance::INT AS n_provenance, term AS term_uri, data_type, unit, name, source FROM registry")
def pipeline_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _registry(spark, sf_dir)
    return done.select("sha256", "n_rows", F.size("provenance").alias("n_provenance"), "term_uri", "data_type", "unit", F.col("provenance")[0]["name"].alias("name"), F.col("provenance")[0]["source"].alias("source"))


@query(_STAGED_SQL + """,
     first AS (SELECT sha256, source, name, class FROM listed QUALIFY row_number() OVER (PARTITION BY sha256, source, name ORDER BY file || source || class || name) = 1)
SELECT source || '/' || class AS schema_id, count(DISTINCT name)::INT AS n_properties FROM first GROUP BY 1
""")
def pipeline_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property of a schema is resolved to the hash of a committed element."""
    registry = _registry(spark, sf_dir)
    done = pipeline.resolved_schemas(pipeline.schemas_of(registry), registry)
    return done.select("schema_id", F.size(F.filter("properties", lambda p: p.rlike("^[0-9a-f]{64}$"))).alias("n_properties"))


_PAIRS_SQL = """,
     pairs AS (SELECT a.sha256 AS a_id, b.sha256 AS b_id, a.data_type AS ta, b.data_type AS tb, a.unit AS ua, b.unit AS ub FROM registry a JOIN registry b ON a.sha256 < b.sha256
               AND (a.term = b.term OR (lower(a.name) = lower(b.name) AND a.source <> b.source))),
     made AS (SELECT a_id, b_id, CASE WHEN ta = tb THEN 'identity' ELSE 'unknown' END AS kind FROM pairs WHERE ta <> tb OR ua IS NOT DISTINCT FROM ub)
"""


@query(_STAGED_SQL + _PAIRS_SQL + "SELECT a_id, b_id, kind AS function_type FROM made")
def pipeline_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.edges(_registry(spark, sf_dir)).select("a_id", "b_id", "function.function_type")


@query(_STAGED_SQL + """
SELECT a.sha256 AS a_id, b.sha256 AS b_id, 0.7::DOUBLE AS score FROM registry a JOIN registry b ON a.sha256 < b.sha256 AND a.data_type = b.data_type AND a.term = b.term AND lower(a.name) = lower(b.name)
""")
def pipeline_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are compared here; only equal ones reach the threshold beside a common term."""
    return pipeline.aligned(_registry(spark, sf_dir), 0.7)[0].select("a_id", "b_id", "score")


@query(_STAGED_SQL + _PAIRS_SQL + """
SELECT 'element:' || data_type AS kind, count(*)::BIGINT AS n FROM registry GROUP BY 1
UNION ALL SELECT 'transform:' || kind, count(*) FROM made GROUP BY 1
UNION ALL SELECT 'flag:needs_review', count(*) FROM made WHERE kind = 'unknown' HAVING count(*) > 0
UNION ALL SELECT 'flag:unknown_source', count(DISTINCT class) FROM staged WHERE source = 's4' HAVING count(*) > 0
UNION ALL SELECT 'pair:skos:relatedMatch', count(*) FROM registry a JOIN registry b ON a.sha256 < b.sha256 AND a.data_type = b.data_type AND a.term = b.term AND lower(a.name) = lower(b.name) HAVING count(*) > 0
""")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(_extracted(spark, sf_dir), SOURCES, threshold=0.7).summary
