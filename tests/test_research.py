"""Readers of research standards, the pipeline and the stores, on small files written here."""

import json

import pytest
from pyspark.sql import functions as F

from regolith.plans import pipeline
from regolith.sources import dictionaries, registry, research, stores


def put(folder, name, doc):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))


def by_name(df):
    return {(r.entity_type, r["name"]): r for r in df.collect()}


def test_bids(spark, tmp_path):
    put(tmp_path, "schema.json", {"objects": {"metadata": {"EchoTime": {"name": "EchoTime", "type": "number", "unit": "s", "minimum": 0}, "Hand": {"type": "string", "enum": ["R", "L"]}}, "columns": {"age": {"type": "number"}}, "enums": {"left": {"value": "L"}}}, "rules": {"sidecars": {"mri": {"Timing": {"fields": {"EchoTime": "required"}}}}}})
    got = by_name(research.bids(spark, str(tmp_path)))
    assert (got["attribute", "EchoTime"].data_type, got["attribute", "EchoTime"].unit, got["attribute", "EchoTime"].min_value) == ("float", "s", 0.0)
    assert got["valueset", "Hand"].members == ["L", "R"] and ("enum_value", "L") in got and got["class", "Timing"].members == ["EchoTime"]


def test_nwb(spark, tmp_path):
    put(tmp_path, "n.yaml", "groups:\n- neurodata_type_def: Outer\n  doc: d\n  attributes: [{name: rate, dtype: float32, required: false}]\n  datasets: [{name: data, dtype: int8}]\n  groups:\n  - neurodata_type_def: Inner\n    quantity: '*'\n    links: [{name: to, target_type: Outer}]\n")
    got = by_name(research.nwb(spark, str(tmp_path)))
    assert ("class", "Outer") in got and ("class", "Inner") in got
    assert got["attribute", "rate"].data_type == "float" and got["attribute", "rate"].required is False
    assert got["attribute", "data"].data_type == "integer" and got["attribute", "to"].type_ref == "Outer" and got["attribute", "inner"].multivalued


def test_openminds(spark, tmp_path):
    put(tmp_path, "s/p.json", {"_type": "https://x/core/Person", "properties": {"https://x/vocab/age": {"type": "integer"}, "https://x/vocab/org": {"_linkedTypes": ["https://x/core/Organization"]}}, "required": ["https://x/vocab/age"]})
    got = by_name(research.openminds(spark, str(tmp_path / "s")))
    assert got["attribute", "age"].required and got["attribute", "org"].type_ref == "Organization" and ("class", "Person") in got
    put(tmp_path, "i/m.jsonld", {"@type": "https://x/controlledTerms/Species", "name": "mouse", "preferredOntologyIdentifier": "http://purl.obolibrary.org/obo/NCBITaxon_10090"})
    got = by_name(research.openminds_instances(spark, str(tmp_path / "i")))
    assert got["enum_value", "mouse"].ontology_id.endswith("10090") and got["valueset", "Species"].members == ["mouse"]


def test_reproschema(spark, tmp_path):
    put(tmp_path, "mood/mood_schema.json", {"@type": "reproschema:Activity", "id": "mood", "prefLabel": {"en": "Mood"}, "ui": {"order": ["items/q1"]}})
    put(tmp_path, "mood/items/q1.json", {"@type": "reproschema:Field", "id": "q1", "question": {"en": "How?"}, "responseOptions": {"valueType": ["xsd:integer"], "choices": [{"value": 0}, {"value": 1}], "minValue": 0, "maxValue": 1}})
    put(tmp_path, "mood/items/q2.json", {"@type": "reproschema:Field", "id": "q2", "responseOptions": "../shared.json"})
    put(tmp_path, "mood/shared.json", {"valueType": "xsd:boolean"})
    got = by_name(research.reproschema(spark, str(tmp_path)))
    q = got["attribute", "q1"]
    assert (q.data_type, q.options, q.max_value, q["class"]) == ("integer", ["0", "1"], 1.0, "mood") and got["class", "Mood"].members == ["items/q1"]
    assert got["attribute", "q2"].data_type == "boolean"


def test_readers_by_name(spark):
    assert registry.detect("a/B.TSV") == "csv" and registry.detect("x.bin") is None and registry.get("csv") is dictionaries.csv_dictionary
    with pytest.raises(KeyError):
        registry.get("none")


def test_pipeline_and_store(spark, tmp_path):
    put(tmp_path, "a.csv", "name,type,label\nage,float,Age in years at least 3\nage,float,Age in years at least 3\nsex,text,\n")
    put(tmp_path, "b.csv", "name,type,label\nAge,float,Age in months\n")
    rows = dictionaries.csv_dictionary(spark, str(tmp_path / "a.csv")).unionByName(dictionaries.csv_dictionary(spark, str(tmp_path / "b.csv")).withColumn("source", F.lit("other")))
    done = pipeline.enriched(pipeline.staged(rows))
    ages = {r["name"]: r for r in done.collect()}
    assert done.count() == 3 and ages["age"].unit == "years" and ages["age"].min_value == 3.0 and ages["age"].unit_uri.endswith("/YR") and ages["sex"].value_domain == "text"
    registry_rows = pipeline.committed(done, ["csv", "other"])
    made = pipeline.edges(registry_rows)
    assert registry_rows.count() == 3 and pipeline.committed(done, ["csv"]).count() == 2
    assert {r.kind: r.n for r in pipeline.summary(registry_rows, made).collect()}["element:float"] == 2
    stores.write(done, f"{tmp_path}/store")
    assert stores.read(spark, f"{tmp_path}/store", source="other").count() == 1
    stores.export({"elements": registry_rows, "transforms": made}, f"{tmp_path}/export")
    assert stores.validate(spark, f"{tmp_path}/export").collect() == []
    registry_rows.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/export/elements")
    assert [tuple(r) for r in stores.validate(spark, f"{tmp_path}/export").collect()] == [("elements", "differs")]
