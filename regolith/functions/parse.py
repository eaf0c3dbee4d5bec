"""Parsers of the short notations in data dictionaries, and type inference over their values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of type columns, tried in this order; the first that the type contains decides.
TYPE_KEYWORDS = [
    ("int", "integer"), ("integer", "integer"), ("numeric", "float"), ("number", "float"), ("float", "float"),
    ("decimal", "float"), ("double", "float"), ("bool", "boolean"), ("boolean", "boolean"), ("yesno", "boolean"),
    ("date", "string"), ("datetime", "string"), ("text", "string"), ("string", "string"), ("dropdown", "string"),
    ("radio", "string"), ("checkbox", "string"),
]
# Type names of the NDA dictionary; others are strings.
NDA_TYPES = {"String": "string", "Integer": "integer", "Float": "float", "Date": "string", "Thumbnail": "string", "File": "string", "GUID": "string", "Conditional": "string"}
INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"
FLOAT = r"(?i)^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"
BOOLEANS = ["true", "false", "yes", "no", "1", "0"]
#: More distinct values than this are not categories; a single one is none either.
CATEGORIES = 30


def keyword_type(raw_type: Column) -> Column:
    """Data type of a dictionary's type column."""
    low = F.lower(F.trim(raw_type))
    head, *rest = TYPE_KEYWORDS
    chain = reduce(lambda c, k: c.when(low.contains(k[0]), k[1]), rest, F.when(low.contains(head[0]), head[1]))
    return chain.otherwise("string")


def nda_type(raw: Column) -> Column:
    named = [(k, v) for k, v in NDA_TYPES.items() if v != "string"]
    return reduce(lambda c, k: c.when(raw == k[0], k[1]), named[1:], F.when(raw == named[0][0], named[0][1])).otherwise("string")


def choices(raw: Column) -> Column:
    """Labels of a choice list: `code, label | …`, else split at `;`, else at `,`, else the one value."""

    def parts(sep):
        return F.filter(F.transform(F.split(raw, sep), lambda p: F.trim(p)), lambda p: p != "")

    piped = F.transform(F.split(raw, r"\|"), lambda p: F.when(p.contains(","), F.trim(F.regexp_replace(F.trim(p), r"(?s)^[^,]*,", ""))).otherwise(F.trim(p)))
    one = F.when(F.trim(raw) != "", F.array(F.trim(raw))).otherwise(F.array().cast("array<string>"))
    return F.when(raw.contains("|"), piped).when(raw.contains(";"), parts(";")).when(raw.contains(","), parts(",")).otherwise(one)


def value_range(raw: Column) -> tuple[Column, Column]:
    """Ends of `a :: b`, either of which may be open; null unless there is exactly one `::`."""
    sides = F.split(raw, "::")
    two = F.size(sides) == 2
    return tuple(F.when(two, F.trim(F.get(sides, F.lit(i))).try_cast("double")) for i in (0, 1))


def notes(raw: Column) -> Column:
    """array<struct<value, label>> of `code=label; …`; entries of another form are left out."""
    form = r"^\s*([^=]+?)\s*=\s*(.+?)\s*$"
    entries = F.filter(F.transform(F.split(raw, ";"), lambda e: F.trim(e)), lambda e: e.rlike(form))
    got = F.transform(entries, lambda e: F.struct(F.trim(F.regexp_extract(e, form, 1)).alias("value"), F.trim(F.regexp_extract(e, form, 2)).alias("label")))
    return F.coalesce(got, F.array().cast("array<struct<value:string,label:string>>"))


def told(value: Column) -> Column:
    """Whether a cell says anything: neither blank nor n/a."""
    return value.isNotNull() & (value != "") & (F.lower(value) != "n/a")


def column_type(value: Column) -> Column:
    """Aggregate: data type of a column of strings."""
    v = F.when(told(value), value)
    integers, numbers = F.bool_and(v.rlike(INTEGER)), F.bool_and(v.rlike(INTEGER) | v.rlike(FLOAT))
    booleans = F.bool_and(F.lower(v).isin(*BOOLEANS))
    return F.when(F.count(v) == 0, "string").when(integers, "integer").when(numbers, "float").when(booleans, "boolean").otherwise("string")


def is_categorical(value: Column) -> Column:
    """Aggregate: whether a string column has between 2 and CATEGORIES distinct values."""
    n = F.count_distinct(F.when(told(value), value))
    return (column_type(value) == "string") & n.between(2, CATEGORIES)
