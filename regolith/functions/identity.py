"""Content identity: canonical JSON, SHA-256, hash modes and URIs.

`canonical` takes the semantic block as a JSON string and runs as an Arrow UDF, since nesting is open and number and escape
formats must be exact. `canonical_flat` is the same for a fixed set of scalar string and integer fields, built from
expressions alone, and stays inside code generation.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where entities live; deployments pass their own.
BASE_URI = "https://registry.example.org"
SHORT_KEY = 12
# Fields outside identity, at every depth, and the constraints that top-level bounds replace.
NOT_IDENTITY = frozenset({"question_text", "value_domain", "ontology_annotations", "description", "unit_uri"})
OLD_CONSTRAINTS = frozenset({"minimum", "maximum"})

ANNOTATION = T.StructType([
    T.StructField("term_uri", T.StringType()),
    T.StructField("term_label", T.StringType()),
    T.StructField("mapping_relation", T.StringType()),
    T.StructField("match_level", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("primary", T.BooleanType()),
])


def _kept(value, under: str = ""):
    """What of a value belongs to identity; None for nothing."""
    if isinstance(value, dict):
        dropped = NOT_IDENTITY | OLD_CONSTRAINTS if under == "constraints" else NOT_IDENTITY
        found = {k: x for k, x in ((k, _kept(v, k)) for k, v in value.items() if k not in dropped) if x is not None}
        return found or None
    if isinstance(value, list):
        found = [_kept(v) for v in value if v is not None]
        if under == "response_options" and found and isinstance(found[0], dict) and "value" in found[0]:
            found.sort(key=lambda o: o.get("value", ""))
        return found or None
    return value


def _compact(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def canonical_of(semantic: dict) -> dict:
    """The identity fields of a semantic block, the unit replaced by its URI where there is one."""
    if semantic.get("unit_uri"):
        semantic = semantic | {"unit": semantic["unit_uri"]}
    return _kept(semantic) or {}


def canonical_json(semantic: dict) -> str:
    return _compact(canonical_of(semantic))


def _loaded(text: str | None) -> dict:
    """A JSON object; an empty one for what is none."""
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


@F.pandas_udf(T.StringType())
def canonical(semantic_json: pd.Series) -> pd.Series:
    """Canonical JSON of a semantic block given as JSON; malformed JSON is an empty block, null stays null."""
    return semantic_json.map(lambda s: None if s is None else canonical_json(_loaded(s)))


def canonical_flat(fields: dict[str, Column]) -> Column:
    """Canonical JSON of scalar fields without nulls inside code generation; names outside identity are dropped."""
    kept = [fields[k].alias(k) for k in sorted(fields) if k not in NOT_IDENTITY]
    return F.to_json(F.struct(*kept))


@F.pandas_udf(T.StringType())
def _identity(semantic_json: pd.Series, uri: pd.Series, cls: pd.Series, name: pd.Series, description: pd.Series) -> pd.Series:
    def one(s, u, c, n, d):
        semantic = _loaded(s)
        block = canonical_of(semantic)
        if u:
            block["_primary_ontology_uri"] = u
        else:
            told = {"_class": c, "_attribute": n, "_description": d or semantic.get("description")}
            block |= {k: v for k, v in told.items() if v}
        return _compact(block)

    return pd.Series([one(*r) for r in zip(semantic_json, uri, cls, name, description)])


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def short_key(sha: Column) -> Column:
    return F.substring(sha, 1, SHORT_KEY)


def entity_uri(kind: str, name: Column, sha: Column, base: str = BASE_URI) -> Column:
    """URI of an entity; kind is elements, schemas, values, valuesets or transforms."""
    return F.concat(F.lit(f"{base}/{kind}/"), F.lower(name), F.lit("_"), short_key(sha))


def primary_annotation(annotations: Column) -> Column:
    """The first annotation flagged primary, else the first of all, else null."""
    return F.coalesce(F.get(F.filter(annotations, lambda a: F.coalesce(a["primary"], F.lit(False))), F.lit(0)), F.get(annotations, F.lit(0)))


def anchor_uri(annotations: Column) -> Column:
    """The primary term's URI if it decides identity: an exact or an element match. A primary that is neither hides the rest."""
    p = primary_annotation(annotations)
    decides = (p["mapping_relation"] == "skos:exactMatch") | (p["match_level"] == "element_match")
    return F.when(F.coalesce(decides, F.lit(False)), p["term_uri"])


def identity_json(semantic_json: Column, provenance: Column, annotations: Column) -> Column:
    """Canonical JSON of an entity: anchored in its ontology term, or structural with the first provenance entry."""
    first = F.get(provenance, F.lit(0))
    return _identity(semantic_json, anchor_uri(annotations), first["class"], first["name"], first["description"])


def checksum_of_set(values: Column) -> Column:
    """Order-free checksum of strings: 16 hex digits."""
    return F.substring(F.sha2(F.array_join(F.array_sort(values), "|"), 256), 1, 16)
