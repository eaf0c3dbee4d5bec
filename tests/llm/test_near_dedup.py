import random

import numpy as np
import pytest

from regolith.llm import near_dedup as nd


def shingles(text, size):
    words = text.encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, size, similar=80):
    sets = {i: shingles(t or "", size) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= similar * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(150):  # a large group of near copies with many rates of change, some of them apart
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 7, 12, 20])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    for i in range(150, 300):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))))
    for i in range(300, 320):  # pairs around the threshold
        words = [rng.choice(vocabulary) for _ in range(90)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words[: 90 - (i - 300)])))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_same_components_as_all_pairs(spark, size):
    rows = corpus()
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
    want = brute(rows, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_light_and_heavy_buckets_give_the_same(spark, monkeypatch):
    rows = corpus()[:200]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    for heavy in (1, 10_000):
        monkeypatch.setattr(nd, "HEAVY", heavy)
        assert {r.doc_id: r.component_id for r in nd.near_duplicates(df, size=2).collect()} == {i: c for i, (_, c) in want.items()}


def test_odd_rows(spark):
    long = "x y " * 50_000 + "end"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A B"), (8, long), (9, long), (None, "a b"), (6, "a b"), (6, "other words here")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, kept int, set_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, size=2).collect()), key=str)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert (4, 1, 4, True) in got and (5, 1, 4, False) in got
    assert got.count((6, 1, 6, True)) == 2 and (7, 1, 6, False) in got and (6, 2, 6, True) in got
    assert (8, 3, 8, True) in got and (9, 3, 8, False) in got
    assert len(got) == len(rows)
    kept = nd.keep_one(df, size=2)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 8]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(df).collect() == []
    assert nd.keep_one(df).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"zz", b"zy")], "a binary, b binary")
    got = {bytes(r.set_id): bytes(r.comp) for r in nd.components(edges).collect()}
    assert got == {bytes([i]): b"\0" for i in range(41)} | {b"zz": b"zy", b"zy": b"zy"}


def test_signatures_meet_near_pairs():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = np.unique(base[:810]), np.unique(base[90:])  # similarity 0.8
        missed += not set(nd.keys(nd.signature(a)).tolist()) & set(nd.keys(nd.signature(b)).tolist())
    assert missed == 0
