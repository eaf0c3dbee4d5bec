"""The full-text index against plain sets of tokens."""

import re

import pytest
from pyspark.sql import functions as F

from regolith.functions import english
from regolith.operators import lexical_index, search
from regolith.operators.lexical_index import LexicalIndex

TEXTS = {"a": "Heart rates at rest", "b": "The heart rate while running", "c": "Running shoes, size in cm", "d": "", "e": None, "f": "rest rest rest"}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id string, text string").repartition(3)


def found(spark, index, *phrases):
    asked = spark.createDataFrame(list(enumerate(phrases)), "query int, phrase string")
    got = {}
    for r in index.search(asked).collect():
        assert r.id not in got.setdefault(r["query"], set())
        got[r["query"]].add(r.id)
    return [got.get(i, set()) for i in range(len(phrases))]


def test_every_token_has_to_be_there(spark, tmp_path):
    index = LexicalIndex.build(frame(spark, TEXTS), f"file://{tmp_path}/index")
    assert found(spark, index, "rate of hearts", "Runs", "running hearts", "resting", "the", "", None, "shoe heart") == [{"a", "b"}, {"b", "c"}, {"b"}, {"a", "f"}, set(), set(), set(), set()]


def test_upserts_take_the_place_of_what_was_there(spark, tmp_path):
    index = LexicalIndex.build(frame(spark, TEXTS), f"file://{tmp_path}/index")
    index.upsert(frame(spark, {"a": "blood pressure", "g": "pressure of the heart"}))
    again = LexicalIndex.open(spark, f"file://{tmp_path}/index")
    assert found(spark, again, "heart", "pressure", "rest") == [{"b", "g"}, {"a", "g"}, {"f"}]
    again.delete(spark.createDataFrame([("g",), ("nobody",)], "id string"))
    again.upsert(frame(spark, {"d": "heart"}))
    assert found(spark, index, "heart", "pressure") == [{"b", "d"}, {"a"}]
    again.upsert(frame(spark, {"g": "back again"}))
    assert found(spark, index, "backs") == [{"g"}]


def test_a_commit_that_was_not_named_is_not_found(spark, tmp_path, monkeypatch):
    index = LexicalIndex.build(frame(spark, TEXTS), f"file://{tmp_path}/index")
    with monkeypatch.context() as m:
        m.setattr(index, "_name", lambda *a: (_ for _ in ()).throw(RuntimeError("the writer dies")))
        with pytest.raises(RuntimeError):
            index.upsert(frame(spark, {"a": "lost words", "z": "lost too"}))
    assert found(spark, index, "lost", "heart") == [set(), {"a", "b"}]
    index.upsert(frame(spark, {"a": "kept words", "z": "kept too"}))
    assert found(spark, index, "lost", "kept", "heart") == [set(), {"a", "z"}, {"b"}]


def test_other_analyzers_are_refused_and_only_buckets_are_read(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/index"
    index = LexicalIndex.build(frame(spark, TEXTS), path, "words")
    assert found(spark, index, "rate", "rates", "the HEART") == [{"b"}, {"a"}, {"b"}]
    with pytest.raises(ValueError, match="'words', not of 'english'"):
        LexicalIndex.open(spark, path)
    with pytest.raises(ValueError, match="no analyzer"):
        LexicalIndex.build(frame(spark, TEXTS), path + "2", "french")
    index.search(spark.createDataFrame([(1, "heart")], "query int, phrase string")).explain()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+\)", capsys.readouterr().out)


def test_search_by_index_is_ranked_like_other_hits(spark, tmp_path):
    entities = spark.createDataFrame([("h1", "element", "Rate"), ("h2", "schema", "Visit")], "sha256 string, kind string, name string")
    index = LexicalIndex.build(spark.createDataFrame([("h1", "heart rates"), ("h2", "rated visits")], "id string, text string"), f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "rating"), (2, "visit")], "query int, phrase string")
    hits = search.full_text_each(entities, index, asked)
    ranked = search.hybrid_each(hits, hits.limit(0), 5)
    assert sorted((r["query"], r.sha256, r.score, r["rank"]) for r in ranked.collect()) == [(1, "h1", 1.0, 1), (1, "h2", 0.9, 2), (2, "h2", 0.9, 1)]


def test_over_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = LexicalIndex.build(docs, f"file://{tmp_path}/index")
    rows = docs.select("id", english.tokens(F.col("text")).alias("t")).collect()
    phrases = [" ".join(r.t[3:6]) for r in rows if r.id % 20 == 0]
    tokens = [set(r.t[0]) for r in spark.createDataFrame(list(enumerate(phrases)), "i int, p string").orderBy("i").select(F.array(english.tokens(F.col("p"))).alias("t")).collect()]
    want = [{r.id for r in rows if t and t <= set(r.t)} for t in tokens]
    assert found(spark, index, *phrases) == want


def test_rows_shuffled_do_not_grow_with_the_queries(spark, tmp_path, monkeypatch):
    """Pairs of query and row are found where rows lie; in blocks of queries and without broadcasts the same ones."""
    words = ["ash", "birch", "cedar", "elm", "fir", "oak", "pine"]
    texts = {f"t{i}": " ".join(w for k, w in enumerate(words) if i >> k & 1) for i in range(128)} | {None: "ash oak"}
    index = LexicalIndex.build(frame(spark, texts).unionByName(frame(spark, {"t1": "oak and ash"})), f"file://{tmp_path}/index", "words")
    phrases = [" ".join(w for k, w in enumerate(words) if j >> k & 1) for j in range(128)] + ["ash", "ash ash", "ash yew", "yew"]
    have = {k: set((v + " oak and ash" * (k == "t1")).split()) for k, v in texts.items() if k}
    want = [{k for k, h in have.items() if p and set(p.split()) <= h} for p in phrases]
    assert found(spark, index, *phrases) == want
    asked = spark.createDataFrame(list(enumerate(phrases)), "query int, phrase string")
    plan = index.search(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "query#" in line]
    monkeypatch.setattr(lexical_index, "BLOCK", 100)
    monkeypatch.setattr(lexical_index, "BROADCAST_ROWS", 0)
    assert found(spark, index, *phrases) == want
