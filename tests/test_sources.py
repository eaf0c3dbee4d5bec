"""Readers on small files written here."""

import json

from regolith.sources import dictionaries, json_schema, linkml, ontologies


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_csv_dictionary(spark, tmp_path):
    f = tmp_path / "Study.csv"
    f.write_text('Variable,Type,Label,Choices\nage,integer,Age,\nsex,radio,"Sex, coded","1, Male | 2, Female"\n,text,no name,\nnote,,,\n')
    got = rows(dictionaries.csv_dictionary(spark, str(f)), "class", "name", "data_type", "description", "options")
    assert got == sorted([("Study", "age", "integer", "Age", None), ("Study", "sex", "string", "Sex, coded", ["Male", "Female"]), ("Study", "note", "string", None, None)], key=str)


def test_profile(spark):
    df = spark.createDataFrame([("1", "a", "n/a"), ("2", "b", None), ("3", "a", "")], "i string, c string, e string")
    assert rows(dictionaries.profile(df), "column", "data_type", "n_told", "categories") == [("c", "string", 3, ["a", "b"]), ("e", "string", 0, None), ("i", "integer", 3, None)]


def test_sidecar(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"Name": "skip", "RepetitionTime": 2.5, "Count": 3, "Flag": True, "L": [1], "O": {"a": 1}, "sex": {"Description": "d", "Levels": {"M": "m", "F": "f"}}, "w": {"Description": "q", "Units": "kg"}}))
    got = {r["name"]: (r["data_type"], r["unit"], r["options"]) for r in dictionaries.sidecar(spark, str(tmp_path)).collect()}
    assert got == {"RepetitionTime": ("float", "s", None), "Count": ("integer", None, None), "Flag": ("boolean", None, None), "L": ("array", None, None), "O": ("object", None, None), "sex": ("string", None, ["F", "M"]), "w": ("string", "kg", None)}


def test_nda(spark, tmp_path):
    shared = {"name": "guid", "type": "GUID", "description": "id"}
    for n, extra in (("a01", {"name": "score", "type": "Integer", "valueRange": "0 :: 1200"}), ("b01", {"name": "sex", "type": "String", "notes": "1=M; 2=F"})):
        (tmp_path / f"{n}.json").write_text(json.dumps({"shortName": n, "dataElements": [shared, extra, {"name": ""}]}))
    all_ = dictionaries.nda_structures(spark, str(tmp_path))
    got = {r["name"]: r for r in dictionaries.nda_dedup(all_).collect()}
    assert all_.count() == 4 and got["guid"].alias_hints == ["nda:a01", "nda:b01"] and got["guid"]["class"] == "a01"
    assert (got["score"].min_value, got["score"].max_value, got["score"].data_type) == (0.0, 1200.0, "integer") and got["sex"].options == ["1", "2"]


def test_json_schema(spark, tmp_path):
    doc = {
        "title": "Person", "type": "object", "properties": {"age": {"type": "integer", "minimum": 0, "maximum": 150}, "pet": {"$ref": "#/$defs/Pet"}, "day": {"type": ["null", "string"], "format": "date"}, "kind": {"$ref": "#/$defs/Kind"}, "any": {"anyOf": [{"type": "null"}, {"type": "number"}]}},
        "$defs": {"Pet": {"properties": {"owner": {"$ref": "#/$defs/Pet"}}}, "Kind": {"enum": ["b", "a"]}, "One": {"const": "only"}},
        "definitions": {"Alt": {"oneOf": [{"const": "x"}, {"const": "y"}]}},
    }
    (tmp_path / "p.json").write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text("{")
    got = json_schema.extract(spark, str(tmp_path)).collect()
    kinds = {(r.entity_type, r["name"]) for r in got}
    assert {("class", "Person"), ("class", "Pet"), ("valueset", "Kind"), ("valueset", "Alt"), ("enum_value", "a"), ("enum_value", "only"), ("enum_value", "x")} <= kinds
    a = {r["name"]: r for r in got if r.entity_type == "attribute"}
    assert (a["age"].min_value, a["age"].max_value, a["age"].data_type) == (0.0, 150.0, "integer")
    assert (a["pet"].data_type, a["pet"].type_ref) == ("object", "Pet") and a["owner"].type_ref == "Pet"
    assert a["day"].pattern == r"^\d{4}-\d{2}-\d{2}$" and a["kind"].options == ["b", "a"]


def test_linkml(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("""
name: demo
classes:
  Animal: {slots: [weight], attributes: {label: {range: string, required: true}, owner: {range: Person}}}
slots:
  weight: {range: float, minimum_value: 0, annotations: {unit: {value: kg}}}
enums:
  Sex: {permissible_values: {M: {meaning: "X:1"}, F: {}}}
""")
    got = {(r.entity_type, r["name"]): r for r in linkml.extract(spark, str(tmp_path)).collect()}
    assert got["class", "Animal"].members == ["weight", "label", "owner"]
    assert got["attribute", "owner"].type_ref == "Person" and got["attribute", "label"].required
    w = got["attribute", "weight"]
    assert (w.data_type, w.unit, w.min_value, w["class"]) == ("float", "kg", 0.0, "demo")
    assert got["valueset", "Sex"].members == ["F", "M"] and got["enum_value", "M"].ontology_id == "X:1"


def test_ontologies(spark, tmp_path):
    f = tmp_path / "x.obo"
    f.write_text('format-version: 1.2\n\n[Term]\nid: X:1\nname: Root\n\n[Term]\nid: X:2\nname: Child\nsynonym: "Kid" EXACT []\nis_a: X:1 ! Root\nnamespace: n\n\n[Term]\nid: X:3\nname: Old\nis_obsolete: true\n\n[Typedef]\nid: part_of\n')
    terms = ontologies.obo(spark, str(f), "x")
    base = "http://purl.obolibrary.org/obo/X_"
    assert rows(terms, "uri", "label", "synonyms", "deprecated") == [(base + "1", "Root", [], False), (base + "2", "Child", ["Kid"], False), (base + "3", "Old", [], True)]
    assert rows(ontologies.edges(terms), "child", "parent") == [(base + "2", base + "1")]
    g = tmp_path / "x.nt"
    g.write_text(f'<u> <{ontologies.LABEL}> "a label"@en .\n<u> <{ontologies.PARENT}> <v> .\n# comment\n')
    assert rows(ontologies.n_triples(spark, str(g), "y"), "uri", "label", "parents") == [("u", "a label", ["v"])]
