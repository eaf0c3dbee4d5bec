"""Ontologies are loaded once, again where they changed, and not at all where a load dies."""

import pytest

from regolith.sources.ontology_store import OntologyStore

OBO = "format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\nsynonym: \"uno\" EXACT []\n\n[Term]\nid: GO:2\nname: two\nis_a: GO:1 ! one\n"
TTL = "@prefix r: <http://www.w3.org/2000/01/rdf-schema#> . <http://t/1> r:label 'eins' . <http://t/2> r:label 'zwei' ; r:subClassOf <http://t/1> ."


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "go.obo").write_text(OBO)
    (tmp_path / "t.ttl").write_text(TTL)
    return OntologyStore(spark, f"file://{tmp_path}/store")


def wanted(tmp_path):
    return [{"name": "go", "path": f"file://{tmp_path}/go.obo"}, {"name": "t", "path": f"file://{tmp_path}/t.ttl"}]


def labels(df):
    return sorted((r.ontology, r.label) for r in df.collect())


def test_loads_are_idempotent(spark, store, tmp_path):
    assert store.terms().collect() == [] and store.load(wanted(tmp_path), "t0") == {"go": "new", "t": "new"}
    assert labels(store.terms()) == [("go", "one"), ("go", "two"), ("t", "eins"), ("t", "zwei")] and labels(store.terms(["t"])) == [("t", "eins"), ("t", "zwei")]
    assert store.load(wanted(tmp_path), "t1") == {"go": "same", "t": "same"} and store.loads().count() == 2
    (tmp_path / "t.ttl").write_text(TTL + " <http://t/3> r:label 'drei' .")
    assert store.load(wanted(tmp_path), "t2") == {"go": "same", "t": "changed"}
    assert [(r["name"], r.n_terms, r.at) for r in store.current().orderBy("name").collect()] == [("go", 2, "t0"), ("t", 3, "t2")]
    (tmp_path / "t.ttl").write_text(TTL)
    assert store.load(wanted(tmp_path), "t3")["t"] == "changed" and len(labels(store.terms(["t"]))) == 2
    assert store.remove("go", "t4") and not store.remove("go", "t5") and {o for o, _ in labels(store.terms())} == {"t"}
    assert store.load(wanted(tmp_path), "t6")["go"] == "new"


def test_a_load_that_dies_is_not_read(spark, store, tmp_path, monkeypatch):
    store.load(wanted(tmp_path), "t0")
    (tmp_path / "t.ttl").write_text("<http://t/9> <http://www.w3.org/2000/01/rdf-schema#label> 'neun' .")
    with monkeypatch.context() as m:
        m.setattr(store, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.load(wanted(tmp_path), "t1")
    assert labels(store.terms(["t"])) == [("t", "eins"), ("t", "zwei")]
    assert store.load(wanted(tmp_path), "t2")["t"] == "changed" and labels(store.terms(["t"])) == [("t", "neun")]
