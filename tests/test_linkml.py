"""LinkML: what classes inherit, and schemas written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from regolith.sources import linkml

SCHEMA = """
name: s
slots:
  id: {range: string, required: true, description: the id}
  age: {range: integer, minimum_value: 0}
classes:
  Thing: {slots: [id]}
  Named: {attributes: {name: {range: string, description: a name}}}
  Person:
    is_a: Thing
    mixins: [Named]
    slots: [age]
    description: a "person"
    slot_usage: {id: {pattern: "^P"}, name: {required: true}}
  Child: {is_a: Person, slot_usage: {age: {maximum_value: 17}}, attributes: {toy: {range: Toy}}}
  Toy: {attributes: {kind: {range: Kind, multivalued: true, annotations: {unit: kg}}}}
  A: {is_a: B}
  B: {is_a: A, attributes: {x: {range: float}}}
enums:
  Kind: {description: kinds, permissible_values: {ball: {meaning: "http://x/1", description: round}, "a: b": {}}}
"""


def docs(spark, **texts):
    rows = spark.createDataFrame([(f"{k}.yaml", v) for k, v in texts.items()], "file string, text string")
    return rows.select("file", F.try_parse_json(linkml.yaml_to_json("text")).alias("doc"))


def test_what_classes_inherit(spark):
    lines = linkml.linearised(docs(spark, s=SCHEMA)).collect()
    got = {}
    for r in sorted(lines, key=lambda r: (r.depth, r.path)):
        got.setdefault(r["class"], []).append(r.ancestor)
    assert got["Child"] == ["Child", "Person", "Named", "Thing"] and got["Person"] == ["Person", "Named", "Thing"] and got["Toy"] == ["Toy"]
    assert got["A"] == ["A", "B"] and got["B"] == ["B", "A"]  # a circle comes to an end


def test_nearest_definitions_win(spark):
    got = {(r["class"], r["name"]): r for r in linkml.induced(docs(spark, s=SCHEMA)).collect()}
    assert {n for c, n in got if c == "Child"} == {"id", "age", "name", "toy"} and {n for c, n in got if c == "A"} == {"x"}
    child = got["Child", "age"]
    assert (child.range, child.minimum_value, child.maximum_value, child.from_class) == ("integer", "0", "17", "Person")
    assert got["Person", "age"].maximum_value is None
    assert (got["Child", "id"].pattern, got["Child", "id"].required, got["Child", "id"].description, got["Child", "id"].from_class) == ("^P", "true", "the id", "Thing")
    assert got["Thing", "id"].pattern is None and got["Child", "name"].required == "true" and got["Named", "name"].required is None


def told(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.drop("file").collect())


def test_schemas_written_and_read_back_are_the_same(spark):
    other = "name: t\nclasses: {Z: {attributes: {q: {range: boolean}}}}\n"
    first = linkml.extract_docs(docs(spark, s=SCHEMA, t=other, empty="name: e\n")).filter("source <> 'e'")
    written = linkml.documents(first)
    texts = {r.file: r.text for r in written.collect()}
    assert set(texts) == {"s.yaml", "t.yaml"}
    names = list(json.loads(texts["s.yaml"])["classes"])
    assert names.index("Thing") < names.index("Person") < names.index("Child")
    again = linkml.extract_docs(written.select("file", F.try_parse_json("text").alias("doc")))
    assert told(again) == told(first)
    through_yaml = linkml.extract_docs(docs(spark, **{k.removesuffix(".yaml"): v for k, v in texts.items()}))
    assert told(through_yaml) == told(first)


def test_nothing_to_write(spark):
    assert linkml.documents(linkml.extract_docs(docs(spark, e="name: e\n"))).collect() == []
    pytest.importorskip("yaml")
