"""Ontologies kept as tables: loaded from files by a list of what to load, again only where the files have changed.

    path/terms/ontology=<name>/load=<checksum>/   terms, with the parents of each
    path/loads/                                   one row a load, or a removal: name, checksum, number of terms, place in the order

A load writes its terms and is then entered; the last entry of a name tells which terms count. So loading the same files again changes
nothing, one that dies before its entry leaves nothing that is read, and the terms of earlier loads stay as they were.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ontologies, rdf
from .documents import fingerprint

TERM = "uri string, label string, synonyms array<string>, deprecated boolean, namespace string, parents array<string>"
_LOAD = "name string, checksum string, n_terms long, at string, place long"


class OntologyStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def loads(self) -> DataFrame:
        """(name, checksum, n_terms, at, place) of all loads; a removal has no checksum."""
        try:
            return self.spark.read.schema(_LOAD).json(f"{self.path}/loads")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _LOAD)

    def current(self) -> DataFrame:
        """(name, checksum, n_terms, at) of the ontologies that are there."""
        last = self.loads().groupBy("name").agg(F.max_by(F.struct("checksum", "n_terms", "at"), "place").alias("l"))
        return last.select("name", "l.*").filter("checksum is not null")

    def terms(self, names: Iterable[str] | None = None) -> DataFrame:
        """TERM rows with their ontology; of some ontologies, if they are named, whose folders alone are read."""
        held = [r for r in self.current().collect() if names is None or r["name"] in set(names)]  # one row an ontology
        if not held:
            return self.spark.createDataFrame([], f"{TERM}, ontology string")
        paths = [f"{self.path}/terms/ontology={r['name']}/load={r.checksum}" for r in held]
        rows = self.spark.read.option("basePath", f"{self.path}/terms").schema(f"{TERM}, ontology string, load string").parquet(*paths)
        return rows.drop("load")

    def load(self, wanted: list[dict], at: str) -> dict[str, str]:
        """name: new, changed or same, for each of wanted: {"name", "path", "form"}, the form obo, or one of RDF, if the suffix does not tell."""
        known = {r["name"]: r.checksum for r in self.current().collect()}
        states = {}
        for w in wanted:
            name, form = w["name"], w.get("form") or ("obo" if w["path"].lower().endswith(".obo") else None)
            checksum = fingerprint(self.spark, w["path"])
            states[name] = "new" if name not in known else "same" if known[name] == checksum else "changed"
            if states[name] == "same":
                continue
            terms = ontologies.obo(self.spark, w["path"], name) if form == "obo" else ontologies.terms(rdf.triples(self.spark, w["path"], form), name)
            place = f"{self.path}/terms/ontology={name}/load={checksum}"
            terms.select("uri", "label", "synonyms", "deprecated", "namespace", "parents").write.mode("overwrite").parquet(place)
            self._enter(name, checksum, self.spark.read.parquet(place).count(), at)
        return states

    def remove(self, name: str, at: str) -> bool:
        """Whether an ontology was there; it is no more."""
        there = not self.current().filter(F.col("name") == name).isEmpty()
        if there:
            self._enter(name, None, None, at)
        return there

    def _enter(self, name: str, checksum: str | None, n_terms: int | None, at: str) -> None:
        place = (self.loads().agg(F.max("place")).first()[0] or 0) + 1
        self.spark.createDataFrame([(name, checksum, n_terms, at, place)], _LOAD).coalesce(1).write.mode("append").json(f"{self.path}/loads")
