"""Clusters and top-k against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from regolith.llm import centroid_clusters, queries, topk_search


def frame(spark, rows, parts=3):
    """rows: (vec_id, vector); with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, "other", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster string, row int, score int").repartition(parts)


def some(n, width, seed, spread=0.3, centres=6):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 1, (centres, width))
    return [(c[i % centres] + rng.normal(0, spread, width)).tolist() for i in range(n)]


def ints(v):
    return [math.floor(256.0 * x) for x in v]


def usable(v, width=None):
    return v is not None and (width is None or len(v) == width) and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(rows, k, rounds, width):
    kept = [(i, ints(v)) for i, v in rows if usable(v, width)]
    ranked = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    cents = [list(x) for _, x in ranked[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for j, xs in groups.items():
            cents[j] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), names[j]) for i, j, d in found)


def clusters(df, **more):
    got = centroid_clusters.cluster(df, **more).collect()
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def test_clusters_are_those_of_plain_rounds(spark):
    rows = list(enumerate(some(500, 8, 1)))
    rows += [(500, None), (501, [1.0] * 7), (502, [math.nan] * 8), (503, [math.inf] + [0.0] * 7), (504, [None] + [0.0] * 7), (505, [])]
    rows += [(506 + i, rows[3][1]) for i in range(40)] + rows[:20] + [(None, rows[5][1])]  # copies, repeated ids, no id
    for k, rounds in ((20, 5), (1, 2), (2, 3), (9, 0)):
        assert clusters(frame(spark, rows), k=k, rounds=rounds, width=8) == plain_clusters(rows, k, rounds, 8)


def test_ties_go_to_the_smaller_number(spark):
    grid = [[float(a), float(b)] for a in range(-2, 3) for b in range(-2, 3)]
    rows = list(enumerate(grid * 3))
    assert clusters(frame(spark, rows), k=12, rounds=5, width=2) == plain_clusters(rows, 12, 5, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = list(enumerate(some(7, 4, 2)))
    assert clusters(frame(spark, rows), k=40, rounds=5, width=4) == plain_clusters(rows, 40, 5, 4)
    empty = centroid_clusters.cluster(frame(spark, rows).limit(0), width=4)
    assert empty.collect() == [] and empty.columns == centroid_clusters.cluster(frame(spark, rows), width=4).columns


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-2.0e5, 2.0e5) for _ in range(5)]) for i in range(120)]
    assert clusters(frame(spark, rows), k=9, rounds=4, width=5) == plain_clusters(rows, 9, 4, 5)
    with pytest.raises(Exception, match="would not fit"):
        clusters(frame(spark, [(1, [1e9, 0.0])]), k=1, rounds=1, width=2)


def test_bounds_spare_work_and_never_pass_a_distance():
    x = np.floor(256 * np.array(some(2000, 16, 3, spread=0.05, centres=30))).astype(np.int64)
    cents = x[:24].copy()
    found, before, stored = centroid_clusters.nearest(x, cents, None, None, 6), None, 6
    for _ in range(6):
        before, cents = cents, cents.copy()
        for j in np.unique(found[0]):
            cents[j] = x[found[0] == j].sum(0) // (found[0] == j).sum()
        stored = max(3, min(stored, 1 + int(found[6].max())))
        found = centroid_clusters.nearest(x, cents, before, found[:1] + found[2:5], stored)
        d = np.sqrt(((x[:, None, :] - cents[None]) ** 2).sum(2))
        assert (found[0] == d.argmin(1)).all()
        assert (found[3] <= np.take_along_axis(d, found[2], 1)).all()
        for i in range(len(x)):
            others = np.delete(d[i], [found[0][i], *found[2][i]])
            assert not len(others) or found[4][i] <= others.min()
    assert found[5].mean() < len(cents) / 2


def plain_top(rows, k, every):
    kept = [(i, ints(v)) for i, v in rows if usable(v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(kept) if b != a)[:k]
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scored, 1)]
    return sorted(out, key=str)


def top(df, **more):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search(df, **more).collect()), key=str)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_top_k_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "SMALL", 200)
    rows = list(enumerate(some(600, 8, 5)))
    rows += [(600, None), (650, [math.nan] * 8), (700, []), (750, [1.0] * 3), (751, [0.5] * 11), (800, [-math.inf]), (850, [None] * 8), (900, [0.0] * 8)]
    rows += [(901 + i, rows[50][1]) for i in range(30)] + [rows[50], rows[100], (None, rows[50][1])]  # ties, repeated rows, no id
    df = frame(spark, rows)
    if block == 64:
        assert top(df, k=3, every=10) == plain_top(rows, 3, 10)
    shard = topk_search.Shard()  # one task, with blocks of a few vectors
    monkeypatch.setattr(topk_search, "BLOCK", block)
    kept = [(i, np.array(ints(v), np.int64)) for i, v in rows if usable(v) and i is not None]
    for n, (i, x) in enumerate(kept):
        shard.add(n, i, x)
    shard.close()
    for n, (i, q) in enumerate(kept):
        m = [(-int((q[: min(len(q), len(v))] * v[: min(len(q), len(v))]).sum()), j, b) for b, (j, v) in enumerate(kept) if b != n]
        got = shard.best(n, q, 5)
        assert list(zip((-got[2]).tolist(), got[1].tolist(), got[0].tolist())) == sorted(m)[:5]


def test_few_or_no_candidates(spark):
    assert top(frame(spark, [(0, [1.0, 2.0])])) == []
    assert top(frame(spark, [(0, [1.0, 2.0]), (7, [3.0, -1.0])])) == [(0, 1, 7, 65536)]
    assert top(frame(spark, [(0, [1.0, 2.0])]).limit(0)) == []


def test_most_postings_are_left_out():
    """Essential terms are traversed for all vectors, further ones only for those still competitive."""
    x = np.floor(256 * np.array(some(4000, 64, 6, spread=0.1, centres=40))).astype(np.int64)
    block = topk_search.Block([(i, i, v) for i, v in enumerate(x)])
    need = int(np.sort(x @ x[17])[-6])
    at, _ = block.competitive(x[17], 17, 5, need)
    assert len(at) < 20


def test_registered_queries_are_those_of_plain_loops(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in queries.QUERIES["op12_centroid_clusters"](spark, sf).collect())
    assert got == plain_clusters(rows, 40, 5, 64)
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.QUERIES["op13_topk_search"](spark, sf).collect()), key=str)
    assert got == plain_top(rows, 5, 50)
