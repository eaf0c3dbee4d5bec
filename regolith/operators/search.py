"""Lexical, semantic and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base scores of lexical hits by kind.
BASE = {"element": 1.0, "schema": 0.9, "value": 0.8, "valueset": 0.7}
#: Queries that meet the entities at once.
BLOCK = 4096


def _base() -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BASE.items() for x in kv)), F.col("kind")), F.lit(0.0))


def lexical(entities: DataFrame, query: str, scored: bool = True) -> DataFrame:
    """(sha256, kind, name, score) of entities (sha256, kind, name, text) whose text holds the query."""
    hit = entities.filter(F.contains(F.lower("text"), F.lit(query.lower())))
    return hit.select("sha256", "kind", "name", (_base() if scored else F.lit(0.0)).alias("score"))


def hybrid(lexical_hits: DataFrame, semantic_hits: DataFrame, first: int) -> DataFrame:
    """(sha256, name, score): both kinds of hits, the better score of each entity, best first, ties by name and hash."""
    both = lexical_hits.select("sha256", "name", "score").unionByName(semantic_hits.select("sha256", "name", "score"))
    best = both.groupBy("sha256").agg(F.max("score").alias("score"), F.min("name").alias("name"))
    return best.orderBy(F.desc("score"), F.lower("name"), "sha256").limit(first)


def lexical_each(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, sha256, kind, name, score) of the entities whose text holds a query's phrase; asked: (query, phrase), a stated set.

    A substring has no key to join on, so queries are broadcast, BLOCK at a time, to where the entities lie. Null and
    empty phrases find nothing.
    """
    phrases = asked.filter("phrase <> ''").select("query", F.lower("phrase").alias("phrase"))
    blocks = max(1, -(-phrases.count() // BLOCK))
    low = entities.select("sha256", "kind", "name", F.lower("text").alias("text"), _base().alias("score"))
    found = None
    for b in range(blocks):
        some = F.broadcast(phrases.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b))
        part = low.join(some, F.contains("text", "phrase")).select("query", "sha256", "kind", "name", "score")
        found = part if found is None else found.unionByName(part)
    return found


def lexical_first(entities: DataFrame, asked: DataFrame, semantic_hits: DataFrame, first: int, near: int) -> DataFrame:
    """The hits of lexical_each() that decide the first of hybrid_each(), where a query has at most `near` semantic hits.

    Each phrase is looked for once, however many queries have it. Of its hits the best first + near are enough: at most `near` of them are
    semantic hits too, whose order may differ, and first of the others stay. All hits that are semantic ones too are looked up by their hashes.
    """
    told = asked.filter("phrase <> ''").select("query", F.lower("phrase").alias("phrase"))
    hits = lexical_each(entities, told.select(F.col("phrase").alias("query"), "phrase").distinct()).withColumnRenamed("query", "phrase")
    order = Window.partitionBy("phrase").orderBy(F.desc("score"), F.lower("name"), "sha256")
    best = hits.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= first + near).drop("_at")
    low = entities.select("sha256", "kind", "name", F.lower("text").alias("text"), _base().alias("score"))
    both = semantic_hits.select("query", "sha256").join(told, "query").join(low, "sha256").filter(F.contains("text", "phrase"))
    columns = ("query", "sha256", "kind", "name", "score")
    return told.join(best, "phrase").select(*columns).unionByName(both.select(*columns))


def hybrid_each(lexical_hits: DataFrame, semantic_hits: DataFrame, first: int) -> DataFrame:
    """(query, sha256, name, score, rank): for each query its first entities of both kinds of hits, ordered as hybrid() orders them.

    Spark limits the rows of a query in each task before they are shuffled, so a phrase that is everywhere sends few.
    """
    both = lexical_hits.select("query", "sha256", "name", "score").unionByName(semantic_hits.select("query", "sha256", "name", "score"))
    best = both.groupBy("query", "sha256").agg(F.max("score").alias("score"), F.min("name").alias("name"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.lower("name"), "sha256")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)


def full_text_each(entities: DataFrame, index, asked: DataFrame) -> DataFrame:
    """(query, sha256, kind, name, score) of the entities (sha256, kind, name) that a full-text index finds for each phrase; asked: (query, phrase)."""
    hits = index.search(asked).withColumnRenamed("id", "sha256")
    return hits.join(entities.select("sha256", "kind", "name", _base().alias("score")), "sha256").select("query", "sha256", "kind", "name", "score")
