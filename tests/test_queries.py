"""Every query with SQL gives DuckDB's rows on the small tables."""

import math

import pytest

import __spark_entry__
from regolith.plans import queries as registry_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(frame):
    def one(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return ""
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v) else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry_queries.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    got, want = registry_queries.QUERIES[name](spark, sf).toPandas(), duck.sql(registry_queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_difflib_ratio_is_the_librarys(spark, sf):
    from difflib import SequenceMatcher

    parts = sorted(spark.read.parquet(f"{sf}/part.parquet").select("p_brand", "p_partkey", "p_name").collect())
    want = {a.p_partkey: round(SequenceMatcher(None, a.p_name.lower(), b.p_name.lower()).ratio(), 6) for a, b in zip(parts, parts[1:]) if a.p_brand == b.p_brand}
    got = {r.p_partkey: r.ratio for r in registry_queries.QUERIES["difflib_ratio"](spark, sf).collect()}
    assert got == pytest.approx(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_lists(spark):
    assert set(registry_queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_llm(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(registry_queries.QUERIES)
