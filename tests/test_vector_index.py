"""The vector index against all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import vector_index
from regolith.operators.vector_index import VectorIndex
from regolith.operators.vectors import HASHED, hashed_vector
from tests.test_vector_join import cosine, vectors


def plain(queries, items, k):
    out = []
    for q, v in queries:
        best = sorted((-round(cosine(v, w), 12), i) for i, w in items if w is not None)[:k]
        out += [(q, i, -s, n) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def rows(df):
    return sorted((r["query"], r["item"], r["score"], r["rank"]) for r in df.collect())


def same(got, want):
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def frame(spark, name, rows):
    return spark.createDataFrame(rows, f"{name} long, vector array<double>").repartition(3)


def test_all_cells_are_exact_and_few_are_near(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(vector_index, "PART", 90)
    items = list(enumerate(vectors(900, 10, 2, centres=40, spread=0.3)))
    items += [(900 + i, items[3][1]) for i in range(200)]  # a vector that many share: ties, and a cell of several parts
    items += [(2000, None), (2001, [0.0] * 10), (2002, [1.0] * 4)]
    index = VectorIndex.build(frame(spark, "item", items), f"file://{tmp_path}/index", "some", cells=16)
    asked = items[:300] + [(5000, [0.0] * 10), (5001, [1.0] * 4)]
    want = plain(asked, items, 7)
    queries = frame(spark, "query", asked)
    again = VectorIndex.open(spark, f"file://{tmp_path}/index", "some")
    same(rows(again.search(queries, 7)), want)
    same(rows(vector_index.nearest(queries, frame(spark, "item", items), 7)), want)
    few = {(q, i) for q, i, _, _ in rows(index.search(queries, 7, probes=5))}
    exact = {w[:2] for w in want}
    assert len(few & exact) / len(exact) >= 0.9
    again.search(queries.filter("query = 0"), 3, probes=1).explain()
    (cell,) = {r.cell for r in again.rows().filter("item = 0").collect()}
    assert re.search(rf"PartitionFilters: \[[^]]*cell#\d+ = {cell}\)", capsys.readouterr().out)  # other cells are not read


def test_append_and_reopen(spark, tmp_path):
    first, second = list(enumerate(vectors(120, 6, 5))), [(1000 + i, v) for i, v in enumerate(vectors(80, 6, 6))]
    path = f"file://{tmp_path}/index"
    VectorIndex.build(frame(spark, "item", first), path, "m", cells=5)
    VectorIndex.open(spark, path, "m").append(frame(spark, "item", second))
    opened = VectorIndex.open(spark, path, "m")
    assert opened.rows().count() == 200
    same(rows(opened.search(frame(spark, "query", second[:20]), 4)), plain(second[:20], first + second, 4))
    with pytest.raises(ValueError, match="not of 'other'"):
        VectorIndex.open(spark, path, "other")
    with pytest.raises(Exception):
        VectorIndex.build(frame(spark, "item", first), path, "m", cells=5)  # an index is not overwritten


def test_empty_index(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorIndex.build(frame(spark, "item", [(1, None)]), f"file://{tmp_path}/index", "m")
    index = VectorIndex.build(frame(spark, "item", [(1, [2.0])]), f"file://{tmp_path}/index", "m")
    assert index.search(frame(spark, "query", [(1, None)]), 3).collect() == []
    assert vector_index.nearest(frame(spark, "query", [(1, [1.0])]), frame(spark, "item", [(1, None)]), 3).collect() == []


def test_an_encoder_is_a_parameter(spark, tmp_path):
    words = ["heart rate", "heart rates", "age at visit", "body weight", "", None]
    told = vector_index.encoded(spark.createDataFrame(list(enumerate(words)), "item long, text string"), "text", hashed_vector)
    assert [len(r.vector) if r.vector else None for r in told.orderBy("item").collect()] == [384] * 4 + [None] * 2
    index = VectorIndex.build(told, f"file://{tmp_path}/index", HASHED)
    got = index.search(told.filter("item = 0").select(F.col("item").alias("query"), "vector"), 2).orderBy("rank").collect()
    assert [r["item"] for r in got] == [0, 1] and got[0].score == pytest.approx(1.0, abs=1e-6)


def test_fit_uses_distinct_units():
    c = vector_index.fit(np.array(vectors(200, 5, 1, centres=4, spread=0.01)), 8)
    assert c.shape == (8, 5) and np.allclose(np.linalg.norm(c, axis=1), 1)
