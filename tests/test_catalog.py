"""The stores of a registry: what any storage has to do."""

import json

import pytest
from pyspark.sql import functions as F

from regolith.sources.catalog import Catalog

ROW = "semantic map<string,string>, provenance array<struct<source:string,class:string,name:string,description:string>>, ontology_annotations array<struct<term_uri:string,term_label:string,ontology:string,mapping_relation:string,match_level:string,score:double,model:string,primary:boolean>>, sha256 string, identifier string"
TERM = ("http://x/PATO_1", "male", "pato", "skos:exactMatch", "concept_match", 0.95, "test", True)


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/registry", 4)


def rows(spark, *told):
    """told: (name, source, semantic, annotated)"""
    full = [({k: json.dumps(v) for k, v in semantic.items()}, [(source, "C", name, f"about {name}")], [TERM] if annotated else None, None, None) for name, source, semantic, annotated in told]
    return spark.createDataFrame(full, ROW)


def test_round_trip_filters_and_counts(spark, catalog):
    e = catalog.entities
    assert e.count("elements") == 0 and e.list("elements").collect() == [] and not e.exists("elements", "absent_abc123")
    told = rows(spark, ("age", "bids", {"data_type": "float", "unit": "years"}, False), ("sex", "nwb", {"data_type": "string"}, True), ("weight", "nwb", {"data_type": "float", "range": {"min": 1}}, False))
    e.write_batch("elements", told)
    assert e.count("elements") == 3 and e.count("values") == 0
    assert [r.provenance[0]["name"] for r in e.list("elements", source="bids").collect()] == ["age"]
    assert [r.provenance[0]["name"] for r in e.list("elements", has_annotations=True).collect()] == ["sex"]
    assert e.count("elements", has_annotations=False) == 2 and e.count("elements", data_type="float") == 2 and e.count("elements", source="nwb", data_type="float") == 1
    (age,) = e.list("elements", source="bids").collect()
    assert age.identifier == f"age_{age.sha256[:12]}" and json.loads(age.semantic["unit"]) == "years"
    for ref in (age.identifier, age.sha256, age.sha256[:12]):
        assert e.exists("elements", ref) and e.find("elements", ref).first().sha256 == age.sha256
    assert e.find_by_hash("elements", age.sha256[:12]).first().identifier == age.identifier and e.find_by_hash("elements", "zz").first() is None
    with pytest.raises(ValueError):
        e.write_batch("unknown", told)
    # the same rows again change nothing
    e.write_batch("elements", told)
    assert e.count("elements") == 3
    assert e.delete("elements", age.identifier) and not e.delete("elements", age.identifier) and e.count("elements") == 2


def test_given_hashes_and_all_kinds(spark, catalog):
    sha = "abcdef123456789000000000000000000000000000000000000000000000abcd"
    row = rows(spark, ("age", "bids", {"label": "a"}, False)).withColumn("sha256", F.lit(sha)).withColumn("identifier", F.lit("age_abcdef123456"))
    for kind in ("elements", "schemas", "values", "valuesets"):
        catalog.entities.write_batch(kind, row)
        assert catalog.entities.find_by_hash(kind, "abcdef123456").first().identifier == "age_abcdef123456"


def test_provenance_and_updates(spark, catalog):
    e = catalog.entities
    e.write_batch("elements", rows(spark, ("age", "bids", {"data_type": "float"}, False), ("sex", "bids", {"data_type": "string"}, False)))
    (age,) = e.list("elements", data_type="float").collect()
    more = "sha256 string, provenance array<struct<source:string,class:string,name:string,description:string>>"
    e.merge_provenance("elements", spark.createDataFrame([(age.sha256, [("nwb", "S", "age", "other")]), (age.sha256, [("bids", "S", "age", "again")]), ("absent", [("a", "b", "c", "d")])], more))
    (got,) = e.find("elements", age.sha256).collect()
    assert [(p["source"], p["name"], p["description"]) for p in got.provenance] == [("bids", "age", "about age"), ("nwb", "age", "other")] and e.count("elements") == 2
    e.update("elements", spark.createDataFrame([(age.sha256, "unit", '"kg"'), (age.sha256, "data_type", '"integer"'), ("absent", "unit", '"x"')], "sha256 string, key string, value string"))
    (got,) = e.find("elements", age.sha256).collect()
    assert got.semantic == {"data_type": '"integer"', "unit": '"kg"'} and len(got.provenance) == 2 and e.count("elements") == 2


def test_flags_live_through_their_states(spark, catalog):
    flags = catalog.flags
    told = spark.createDataFrame([("element", "age_1", "low_confidence", "{}"), ("element", "weight_2", "ambiguous_match", "{}"), ("element", "age_1", "low_confidence", "{}")], "entity_type string, entity_ref string, flag_type string, context string")
    flags.write(told, F.lit("t0"))
    flags.write(told.limit(1), F.lit("t1"))
    assert flags.read("pending").count() == 2
    (low,) = flags.read(flag_type="low_confidence").collect()
    decisions = spark.createDataFrame([(low.sha256, "approved", "me", "fine"), ("absent", "approved", "me", "")], "sha256 string, status string, resolved_by string, note string")
    flags.resolve(decisions, F.lit("t2"))
    (done,) = flags.read("approved").collect()
    assert (done.resolved_by, done.resolved_at, done.created_at, done.note) == ("me", "t2", "t0", "fine") and flags.read("pending").count() == 1
    flags.resolve(decisions.withColumn("status", F.lit("rejected")), F.lit("t3"))
    assert flags.read("rejected").collect() == []


def test_runs(spark, catalog):
    told = [("r1", "bids", "2026-01-01", "{}"), ("r2", "bids", "2026-02-01", "{}"), ("r3", "nwb", "2026-01-15", "{}")]
    catalog.runs.save(spark.createDataFrame(told, "run_id string, source string, started_at string, summary string"))
    assert [r.run_id for r in catalog.runs.list().collect()] == ["r2", "r3", "r1"] and [r.run_id for r in catalog.runs.list("bids", 1).collect()] == ["r2"]
    assert {r.source: r.run_id for r in catalog.runs.previous().collect()} == {"bids": "r2", "nwb": "r3"}


def test_a_catalog_is_found_again(spark, catalog, tmp_path):
    catalog.entities.write_batch("values", rows(spark, ("male", "bids", {"label": "male"}, True)))
    again = Catalog(spark, f"file://{tmp_path}/registry", 4)
    assert again.entities.count("values") == 1 and again.flags.read().collect() == []
