"""Readers of datasets and of model dumps, and detection by marker files, on small files written here."""

import json

from regolith.sources import json_schema, registry


def _dataset(root):
    (root / "phenotype").mkdir()
    (root / "sub-01").mkdir()
    (root / "dataset_description.json").write_text(json.dumps({"Name": "n", "BIDSVersion": "1"}))
    (root / "participants.tsv").write_text("participant_id\tage\tsex\tgroup\nsub-01\t31\tM\tn/a\r\nsub-02\t32.5\tF\ta\nsub-03\t\tF\tb\n")
    (root / "participants.json").write_text(json.dumps({"age": {"Description": "Age", "Units": "year", "MinValue": 1, "MaxValue": "99"}, "more": {"sex": {"Levels": {"M": "male", "F": {"x": 1}}}}}))
    (root / "phenotype" / "q.csv").write_text('id,"said, twice"\n1,"a, ""b"""\n2,c\n')
    (root / "phenotype" / "empty.tsv").write_text("only\n")
    (root / "phenotype" / "none.tsv").write_text("")
    (root / "task-rest_bold.json").write_text(json.dumps({"RepetitionTime": 2.5, "Strengths": "x", "License": "skip", "dcmmeta_a": 1, "col": {"Description": "of a table"}}))
    (root / "broken.json").write_text("{")
    (root / "sub-01" / "events.tsv").write_text("onset\n1\n")


def test_openneuro(spark, tmp_path):
    root = tmp_path / "ds000001"
    root.mkdir()
    _dataset(root)
    assert registry.detect_project(spark, str(root)) == "openneuro" and registry.detect_project(spark, str(root / "sub-01")) is None
    rows = registry.get("openneuro")(spark, f"{root}/").collect()
    assert {r.source for r in rows} == {"openneuro/ds000001"}
    by = {(r.entity_type, r["class"], r.name): r for r in rows}
    assert len(by) == len(rows)
    attributes = {k[1:]: (r.data_type, r.unit, r.options) for k, r in by.items() if k[0] == "attribute"}
    assert attributes == {
        ("participants.tsv", "participant_id"): ("string", None, ["sub-01", "sub-02", "sub-03"]), ("participants.tsv", "age"): ("float", "year", None),
        ("participants.tsv", "sex"): ("string", None, ["F", "M"]), ("participants.tsv", "group"): ("string", None, ["a", "b"]),
        ("phenotype/q.csv", "id"): ("integer", None, None), ("phenotype/q.csv", "said, twice"): ("string", None, ['a, "b"', "c"]), ("phenotype/empty.tsv", "only"): ("string", None, None),
        ("task-rest_bold.json", "RepetitionTime"): ("float", "s", None), ("task-rest_bold.json", "Strengths"): ("string", None, None),
    }
    age = by["attribute", "participants.tsv", "age"]
    assert (age.description, age.min_value, age.max_value) == ("Age", 1.0, 99.0)
    assert by["enum_value", "participants.tsv", "sex:M"].description == "male" and by["enum_value", "participants.tsv", "sex:F"].description == "F"
    assert by["valueset", "participants.tsv", "sex_values"].members == ["F", "M"]
    assert by["attribute", "task-rest_bold.json", "RepetitionTime"].description == "BIDS metadata field: RepetitionTime = 2.5"


def test_models(spark, tmp_path):
    kind = {"enum": ["b", "a"], "title": "Kind", "type": "string", "description": "kinds"}
    person = {"title": "Person", "type": "object", "properties": {"name": {"type": "string", "pattern": "^x"}, "n": {"anyOf": [{"type": "integer", "minimum": 2}, {"type": "null"}]}}, "required": ["name"]}
    top = {
        "title": "Set", "type": "object", "description": "A set", "$defs": {"Kind": kind, "Person": person},
        "properties": {"who": {"type": "array", "items": {"$ref": "#/$defs/Person"}}, "kind": {"allOf": [{"$ref": "#/$defs/Kind"}]}, "map": {"type": "object"}, "maybe": {"anyOf": [{"type": "array", "items": {"type": "number"}}, {"type": "null"}]}, "either": {"anyOf": [{"type": "string"}, {"type": "integer"}]}},
        "required": ["kind"],
    }
    (tmp_path / "a.json").write_text(json.dumps(top))
    (tmp_path / "b.json").write_text(json.dumps({"title": "Other", "type": "object", "$defs": {"Person": person}, "properties": {"p": {"$ref": "#/$defs/Person"}}}))
    rows = json_schema.models(spark, str(tmp_path)).collect()
    got = {(r["class"], r.name): (r.data_type, r.type_ref, r.required, r.multivalued) for r in rows if r.entity_type == "attribute"}
    assert got == {
        ("Set", "who"): ("object", "Person", False, True), ("Set", "kind"): ("string", "Kind", True, False), ("Set", "map"): ("string", None, False, False), ("Set", "maybe"): ("float", None, False, True),
        ("Set", "either"): ("string", None, False, False), ("Person", "name"): ("string", None, True, False), ("Person", "n"): ("integer", None, False, False), ("Other", "p"): ("object", "Person", False, False),
    }
    assert sorted((r.entity_type, r.name) for r in rows if r.entity_type != "attribute") == [("class", "Other"), ("class", "Person"), ("class", "Set"), ("enum_value", "a"), ("enum_value", "b"), ("valueset", "Kind")]
    n = next(r for r in rows if r.name == "n")
    assert n.min_value == 2.0 and next(r for r in rows if r.name == "kind").options == ["a", "b"]
