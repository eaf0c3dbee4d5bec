"""Readers by name and by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import datasets, dictionaries, json_schema, linkml, research

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": dictionaries.csv_dictionary, "sidecar": dictionaries.sidecar, "nda": dictionaries.nda_structures, "json-schema": json_schema.extract, "aind": json_schema.extract,
    "linkml": linkml.extract, "bids": research.bids, "nwb": research.nwb, "openminds": research.openminds, "openminds-instances": research.openminds_instances, "reproschema": research.reproschema,
    "dandi": json_schema.models, "openneuro": datasets.openneuro,
}
BY_SUFFIX = {".json": "json-schema", ".yaml": "linkml", ".yml": "linkml", ".csv": "csv", ".tsv": "csv"}

#: Files at the root of a project and the reader that they ask for; code repositories have none here, but one may be registered.
MARKERS = {"dataset_description.json": "openneuro", "pyproject.toml": "code-repo", "package.json": "code-repo"}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Adds a reader of one's own: (spark, path) to ENTITY rows."""
    READERS[name] = reader


def get(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in READERS:
        raise KeyError(f"no reader {name!r}; there are {', '.join(sorted(READERS))}")
    return READERS[name]


def detect(path: str) -> str | None:
    """The reader for a file by its suffix."""
    return next((r for s, r in BY_SUFFIX.items() if path.lower().endswith(s)), None)


def detect_project(spark: SparkSession, path: str) -> str | None:
    """The reader for a folder by the marker files at its root, of which the first in MARKERS with a reader counts; no file is opened."""
    names = "{" + ",".join(MARKERS) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select(F.substring_index("path", "/", -1).alias("name"))
    there = {r.name for r in found.distinct().collect()}  # at most one row a marker
    return next((r for m, r in MARKERS.items() if m in there and r in READERS), None)
