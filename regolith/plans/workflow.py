"""A declared graph of steps with a ledger: what is done is skipped, and a run that failed goes on where it stopped.

A spec names steps, each with an operation, its parameters, and the steps that it reads:

    {"name": "nightly", "steps": [
      {"name": "bids", "run": "extract", "with": {"reader": "csv", "path": "/data/bids.csv", "source": "bids"}},
      {"name": "registry", "run": "ingest", "reads": ["bids"], "with": {"sources": ["bids"]}},
      {"name": "problems", "run": "validate", "reads": ["registry"]},
      {"name": "report", "run": "report", "reads": ["registry", "problems"]}]}

The key of a step is a hash of its operation, its parameters, the keys of the steps it reads and, for steps that read files, a fingerprint of
the files. Its table is written under that key and then entered in the ledger; a step whose key is in the ledger is not run. So a change of a
file or a parameter runs what depends on it and nothing else, and a table that was cut short is never read, since no entry names it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators import quality
from regolith.sources import registry as readers
from regolith.sources.documents import fingerprint

from . import pipeline

Operation = Callable[[SparkSession, list[DataFrame], dict], DataFrame]
_LEDGER = "step string, key string, path string, run string"


@dataclass(frozen=True)
class Step:
    name: str
    run: str
    reads: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)


def parsed(spec: dict | str) -> list[Step]:
    """Steps in an order in which each comes after those it reads; ValueError for names that repeat, are unknown, or go in a circle."""
    told = json.loads(spec) if isinstance(spec, str) else spec
    steps = [Step(s["name"], s["run"], tuple(s.get("reads", ())), s.get("with", {})) for s in told["steps"]]
    names = [s.name for s in steps]
    if len(set(names)) < len(names):
        raise ValueError("steps of one name")
    for s in steps:
        if s.run not in OPERATIONS:
            raise ValueError(f"step {s.name!r}: no operation {s.run!r}; there are {', '.join(sorted(OPERATIONS))}")
        if unknown := [r for r in s.reads if r not in names]:
            raise ValueError(f"step {s.name!r} reads {unknown[0]!r}, which is no step")
    done: list[Step] = []
    while len(done) < len(steps):
        ready = [s for s in steps if s not in done and all(r in {d.name for d in done} for r in s.reads)]
        if not ready:
            raise ValueError("steps that read each other in a circle")
        done += ready
    return done


class Workflow:
    """A spec over a folder that keeps the tables of its steps and the ledger."""

    def __init__(self, spark: SparkSession, spec: dict | str, path: str):
        self.spark, self.steps, self.path = spark, parsed(spec), path

    def ledger(self) -> DataFrame:
        """(step, key, path, run) of every step that was finished."""
        try:
            return self.spark.read.schema(_LEDGER).json(f"{self.path}/ledger")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _LEDGER)

    def keys(self) -> dict[str, str]:
        """The key of each step, as the spec and its files are now."""
        found: dict[str, str] = {}
        for s in self.steps:
            files = fingerprint(self.spark, s.params["path"]) if "path" in s.params else ""
            found[s.name] = hashlib.sha256(json.dumps([s.run, s.params, [found[r] for r in s.reads], files], sort_keys=True).encode()).hexdigest()[:32]
        return found

    def pending(self) -> list[str]:
        """The steps that a run would run."""
        known = {(r.step, r.key) for r in self.ledger().select("step", "key").collect()}  # a row a finished step
        return [name for name, key in self.keys().items() if (name, key) not in known]

    def run(self, run_id: str) -> dict[str, DataFrame]:
        """The table of each step; only those that are pending are computed."""
        keys, pending, out = self.keys(), set(self.pending()), {}
        for s in self.steps:
            at = f"{self.path}/tables/{s.name}/key={keys[s.name]}"
            if s.name in pending:
                OPERATIONS[s.run](self.spark, [out[r] for r in s.reads], s.params).write.mode("overwrite").parquet(at)
                self.spark.createDataFrame([(s.name, keys[s.name], at, run_id)], _LEDGER).coalesce(1).write.mode("append").json(f"{self.path}/ledger")
            out[s.name] = self.spark.read.parquet(at)
        return out


def extract(spark: SparkSession, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Entities of the files at `path` by a `reader` (told by the file, if none is named), as those of `source`."""
    reader = params.get("reader") or readers.detect(params["path"])
    rows = readers.get(reader)(spark, params["path"])
    return rows.withColumn("source", F.lit(params["source"])) if "source" in params else rows


def ingest(spark: SparkSession, inputs: list[DataFrame], params: dict) -> DataFrame:
    """What the tables read say, staged, enriched and committed; sources that are not among `sources` are left out."""
    rows = inputs[0]
    for other in inputs[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return pipeline.committed(pipeline.enriched(pipeline.staged(rows.filter(F.col("entity_type") == pipeline.ELEMENT))), params.get("sources"))


def validate(spark: SparkSession, inputs: list[DataFrame], params: dict) -> DataFrame:
    """(id, rule) of committed elements that break a rule of the registry."""
    rows = inputs[0].select(F.col("sha256").alias("id"), "data_type", "sha256", F.col("sha256").alias("recomputed"))
    return quality.violations(rows, quality.entity_rules())


def transform(spark: SparkSession, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Transforms between committed elements."""
    return pipeline.edges(inputs[0])


def report(spark: SparkSession, inputs: list[DataFrame], params: dict) -> DataFrame:
    """(kind, n): elements by type, problems by rule."""
    out = inputs[0].groupBy(F.concat(F.lit("element:"), "data_type").alias("kind")).agg(F.count("*").alias("n"))
    for problems in inputs[1:]:
        out = out.unionByName(problems.groupBy(F.concat(F.lit("problem:"), "rule").alias("kind")).agg(F.count("*").alias("n")))
    return out


OPERATIONS: dict[str, Operation] = {"extract": extract, "ingest": ingest, "validate": validate, "transform": transform, "report": report}


def register(name: str, operation: Operation) -> None:
    """Adds an operation of one's own: (spark, tables that it reads, parameters) to a table."""
    OPERATIONS[name] = operation

