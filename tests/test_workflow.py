"""Workflows: order, skipping, changes, and going on after a failure."""

import pytest

from regolith.plans import workflow
from regolith.plans.workflow import Workflow, parsed


def spec(tmp_path, **more):
    return {"name": "w", "steps": [
        {"name": "report", "run": "report", "reads": ["registry", "problems"]},
        {"name": "a", "run": "extract", "with": {"reader": "csv", "path": f"file://{tmp_path}/a.csv", "source": "one"}},
        {"name": "b", "run": "extract", "with": {"path": f"file://{tmp_path}/b.csv", "source": "two"}},
        {"name": "registry", "run": "ingest", "reads": ["a", "b"], "with": {"sources": ["one", "two"]} | more},
        {"name": "problems", "run": "validate", "reads": ["registry"]},
    ]}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_text("name,type,label\nage,float,Age\nsex,text,\n")
    (tmp_path / "b.csv").write_text("name,type,label\nAge,float,Age in months\n")
    return tmp_path


def counts(df):
    return {r.kind: r.n for r in df.collect()}


def test_steps_in_order_and_only_what_changed(spark, files):
    flow = Workflow(spark, spec(files), f"file://{files}/w")
    assert [s.name for s in flow.steps] == ["a", "b", "registry", "problems", "report"] and set(flow.pending()) == {s.name for s in flow.steps}
    assert counts(flow.run("r1")["report"]) == {"element:float": 2, "element:string": 1}
    assert flow.pending() == [] and counts(flow.run("r2")["report"]) == {"element:float": 2, "element:string": 1}
    assert {r.run for r in flow.ledger().collect()} == {"r1"}
    (files / "b.csv").write_text("name,type,label\nAge,float,Age in months\nweight,integer,\n")
    assert flow.pending() == ["b", "registry", "problems", "report"]
    assert counts(flow.run("r3")["report"]) == {"element:float": 2, "element:string": 1, "element:integer": 1}
    assert Workflow(spark, spec(files, sources=["one"]), flow.path).pending() == ["registry", "problems", "report"]
    (files / "b.csv").write_text("name,type,label\nAge,float,Age in months\n")
    assert flow.pending() == []  # what was there before has its tables still


def test_a_run_goes_on_where_it_failed(spark, files, monkeypatch):
    whole = Workflow(spark, spec(files), f"file://{files}/whole").run("r")["report"]
    flow, ran = Workflow(spark, spec(files), f"file://{files}/cut"), []

    def dies(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setitem(workflow.OPERATIONS, "validate", dies)
        with pytest.raises(RuntimeError):
            flow.run("r1")
    assert flow.pending() == ["problems", "report"]
    for name, operation in list(workflow.OPERATIONS.items()):
        monkeypatch.setitem(workflow.OPERATIONS, name, lambda *a, name=name, operation=operation: (ran.append(name), operation(*a))[1])
    assert counts(flow.run("r2")["report"]) == counts(whole) and ran == ["validate", "report"]


def test_specs_that_make_no_sense(monkeypatch):
    one = {"name": "x", "run": "report", "reads": ["x"]}
    for steps in ([one], [one, one], [{"name": "x", "run": "report", "reads": ["y"]}], [{"name": "x", "run": "nothing"}]):
        with pytest.raises(ValueError):
            parsed({"steps": steps})
    monkeypatch.setitem(workflow.OPERATIONS, "mine", lambda spark, inputs, params: inputs[0])
    assert [s.run for s in parsed('{"steps": [{"name": "m", "run": "mine", "reads": ["e"]}, {"name": "e", "run": "extract", "with": {"path": "p"}}]}')] == ["extract", "mine"]
