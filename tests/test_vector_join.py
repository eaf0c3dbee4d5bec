"""The cosine join against all pairs, and what is built on it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import align, transforms, vector_join


def vectors(n, width=12, seed=1, centres=9, spread=0.25):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 1, (centres, width))
    return [(c[i % centres] + rng.normal(0, spread, width)).tolist() for i in range(n)]


def cosine(a, b):
    la, lb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (la * lb) if la and lb and len(a) == len(b) else 0.0


def plain(rows, threshold):
    out = {}
    for i, (a, v, g, s) in enumerate(rows):
        for b, w, h, t in rows[:i]:
            if a != b and g == h and (s is None or s != t) and None not in (v, w) and round(cosine(v, w), 12) >= threshold:
                out[min(a, b), max(a, b)] = cosine(v, w)
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.97])
@pytest.mark.parametrize("pivots", [0, 2, 25])
def test_same_pairs_as_all_pairs(spark, threshold, pivots):
    rng = random.Random(3)
    rows = [(i, v, rng.choice("gh"), rng.choice(["s", "t", "u", None])) for i, v in enumerate(vectors(260))]
    rows += [(1000 + i, rows[7][1], "g", f"x{i}") for i in range(60)]  # one vector that many share
    rows += [(2000, None, "g", "s"), (2001, [0.0] * 12, "g", "s"), (2002, [1.0] * 5, "g", "s"), (2003, [2.0] * 5, "g", "t"), (2004, [], "g", None), (2005, [math.nan] * 12, "g", "z"), (2006, [1e100] * 12, "g", "z")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, group string, apart string").repartition(3)
    got = vector_join.similar_pairs(df, threshold, pivots, block=40).collect()
    found = {(r.a_id, r.b_id): r.score for r in got}
    want = plain([r for r in rows if r[0] != 2005], threshold)
    assert len(found) == len(got) and found.keys() == want.keys()
    assert all(abs(found[p] - want[p]) < 1e-9 for p in want)


def test_ids_of_text_and_no_rows(spark):
    rows = [(f"n{i}", v, "", None) for i, v in enumerate(vectors(40))]
    df = spark.createDataFrame([r[:2] for r in rows], "id string, vector array<float>")
    want = plain([(i, np.float32(v).astype(float).tolist(), g, s) for i, v, g, s in rows], 0.9)
    assert {(r.a_id, r.b_id) for r in vector_join.similar_pairs(df, 0.9).collect()} == want.keys()
    assert vector_join.similar_pairs(df.limit(0), 0.9).collect() == []
    with pytest.raises(ValueError):
        vector_join.similar_pairs(df, 0.0)


def test_cells_spare_work(spark):
    df = spark.createDataFrame(list(enumerate(vectors(3000, centres=60, spread=0.05))), "id long, vector array<double>")
    work = vector_join.planned_work(df, 0.9, 60).first()
    assert work.vectors == 3000 and work.all_pairs == 3000 * 2999 // 2
    assert work.comparisons < work.all_pairs / 4
    found = vector_join.similar_pairs(df, 0.9, 60).count()
    assert found == vector_join.similar_pairs(df, 0.9, 0).count() >= 60 * 50 * 49 // 2  # pairs of one centre, and no pair lost


def alias_rows(n, seed):
    rng = random.Random(seed)
    base = vectors(n, 6, seed, centres=5, spread=0.2)
    names = ["heart rate", "Heart_Rate", "rate of heart", "age", "age at visit", "", None, "x"]
    out = []
    for i in range(n):
        choices = rng.choice([["yes", "no"], ["Yes", "no"], ["yes"], ["a", "b", "c"], ["a", "b"], [], None])
        lo = rng.choice([None, 0.0, 0.0, 5.0])
        out.append((i, rng.choice(["integer", "string"]), rng.choice([None, "t1", "t2", "t3"]), lo, None if lo is None else lo + rng.choice([0.0, 1.0, 10.0]), choices, base[i] if rng.random() < 0.6 else None, rng.choice([None, [], ["h1"], ["h1", "h2"]]) if rng.random() < 0.1 else None, rng.choice(names)))
    return out


def test_alias_candidates_lose_no_pair(spark):
    """Against the scores of all pairs of a data type."""
    schema = "id long, data_type string, term_uri string, min_value double, max_value double, choices array<string>, vector array<double>, hints array<string>, name string"
    rows = spark.createDataFrame(alias_rows(150, 9), schema)
    for threshold in (0.46, 0.5, 0.62):
        a = rows.select("data_type", F.col("id").alias("a_id"))
        pairs = a.join(rows.select("data_type", F.col("id").alias("b_id")), "data_type").filter("a_id < b_id").select("a_id", "b_id")
        full = align._scored(pairs, rows.withColumn("measured", F.col("vector").isNotNull()), threshold, True)
        want = {(r.a_id, r.b_id): (r.score, r.relation) for r in full.collect()}
        got = {(r.a_id, r.b_id): (r.score, r.relation) for r in align.candidates(rows, threshold).collect()}
        assert got == want and len(want) > 100


def test_transforms_by_vector(spark):
    """Elements of different sources whose vectors are alike, and no others, get transforms of the third strategy."""
    v = vectors(60, 8, 4, centres=5, spread=0.15)
    rows = [(i, f"s{i % 3}", None, f"name {i}", f"h{i}", "integer", "kg", "", ["a"] if i % 2 else [], None, x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, source string, term_uri string, name string, sha256 string, data_type string, unit string, value_domain string, choices array<string>, structural_type string, vector array<double>")
    got = {(r.a_id, r.b_id): r.strategy for r in transforms.generate(df).collect()}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3 and cosine(v[a], v[b]) >= 0.8}
    assert got == dict.fromkeys(want, 3) and want
    assert transforms.generate(df.drop("vector")).collect() == [] == transforms.generate(df, similar=None).collect()
