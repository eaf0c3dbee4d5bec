"""Lookups, filters, keyset pages and counts over registry tables."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that each kind may be sorted by.
SORTS = {
    "elements": ("name", "data_type", "unit", "value_domain", "description"),
    "schemas": ("name", "description"),
    "values": ("name", "label", "description"),
    "valuesets": ("name", "description"),
}


def by_prefix(rows: DataFrame, prefix: str, column: str = "sha256") -> DataFrame:
    """The first row whose hash starts so; the prefix reaches the Parquet scan."""
    return rows.filter(F.col(column).startswith(prefix)).orderBy(column).limit(1)


def read_any(rows: DataFrame, ref: str) -> DataFrame:
    """A row by hash prefix, else file name, else file name with .yaml."""
    rank = F.when(F.col("sha256").startswith(ref), 0).when(F.col("file_name") == ref, 1).when(F.col("file_name") == ref + ".yaml", 2)
    return rows.withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank", "sha256").limit(1).drop("_rank")


def of_source(source: str) -> Column:
    return F.exists("provenance", lambda p: p["source"] == source)


def of_source_prefix(source: str) -> Column:
    """The looser test of browsing."""
    return F.exists("provenance", lambda p: p["source"].startswith(source))


def has_annotations(wanted: bool = True) -> Column:
    some = F.coalesce(F.size("ontology_annotations") > 0, F.lit(False))
    return some if wanted else ~some


def says(text: str, *columns: str) -> Column:
    """Whether any of the columns holds the text, regardless of case. Wildcards stand for themselves."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(text))), F.lit(False))
    return found


def matches_all(tokens: Column, query_tokens: Column) -> Column:
    """Full-text predicate: every query token is in the row's tokens."""
    return F.forall(query_tokens, lambda t: F.array_contains(tokens, t))


def uses(column: str, sha: str) -> Column:
    """Whether an array of references has a hash: schemas that use an element."""
    return F.array_contains(F.col(column), sha)


def touches(sha: str) -> Column:
    """Whether a transform starts or ends at an element."""
    return F.contains(F.col("source_element"), F.lit(sha)) | F.contains(F.col("target_element"), F.lit(sha))


def encode_cursor(value, key) -> str:
    return base64.b64encode(json.dumps([value, key]).encode()).decode()


def decode_cursor(cursor: str) -> tuple:
    return tuple(json.loads(base64.b64decode(cursor)))


def after(sort: str, key: str, cursor: tuple, descending: bool = False) -> Column:
    """Rows behind (value, key) in the order of sort, nulls last, then key."""
    value, last = cursor
    s, k = F.col(sort), F.col(key)
    if value is None:
        return s.isNull() & (k > last)
    beyond = s < value if descending else s > value
    return beyond | s.isNull() | ((s == value) & (k > last))


def page(rows: DataFrame, sort: str, key: str, first: int, cursor: tuple | None = None, descending: bool = False) -> DataFrame:
    """A keyset page and one row more, which tells whether another page follows; no offset is ever counted off."""
    if cursor is not None:
        rows = rows.filter(after(sort, key, cursor, descending))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(order, F.asc(key)).limit(first + 1)


def page_of(kind: str, rows: DataFrame, sort: str, first: int, cursor: tuple | None = None, descending: bool = False) -> DataFrame:
    """A page of one kind of entity, sorted by one of the columns that it may be sorted by, then by hash."""
    if sort not in SORTS[kind]:
        raise ValueError(f"{kind} sort by {', '.join(SORTS[kind])}, not {sort!r}")
    return page(rows, sort, "sha256", first, cursor, descending)


def newest(rows: DataFrame, at: str, key: str, first: int = 50, equal: dict[str, object] | None = None, prefix: dict[str, str] | None = None) -> DataFrame:
    """The newest rows whose columns equal some values and begin with others; values of None ask for nothing. Ties by key.

    Ingestion jobs by status, proposals by type, reference and status, ontologies by whether they are active.
    """
    for column, wanted in (equal or {}).items():
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    for column, wanted in (prefix or {}).items():
        if wanted is not None:
            rows = rows.filter(F.startswith(F.col(column), F.lit(wanted)))
    return rows.orderBy(F.desc_nulls_last(at), key).limit(first)


def total(rows: DataFrame) -> DataFrame:
    """(total) of filtered rows, beside a page of them."""
    return rows.agg(F.count("*").alias("total"))


def counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def flatten(rows: DataFrame, fields: tuple[str, ...], column: str = "semantic") -> DataFrame:
    """Fields of the semantic block as columns of their own."""
    return rows.select("*", *(F.col(f"{column}.{f}").alias(f) for f in fields))
