"""Fields inferred from descriptions: units, formats, bounds, domains, ontologies, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_I = "(?i)"
# Unit patterns in the order in which they are tried. An inferred "millimeters" is met by the pattern of
# meters first; CORRECTED_UNITS puts the longer names before the shorter.
UNIT_PATTERNS: list[tuple[str, str]] = [
    (_I + r"\b(?:in\s+)?years?\b", "years"),
    (_I + r"\b(?:in\s+)?months?\b", "months"),
    (_I + r"\b(?:in\s+)?days?\b", "days"),
    (_I + r"\b(?:in\s+)?hours?\b", "hours"),
    (_I + r"\b(?:in\s+)?minutes?\b", "minutes"),
    (_I + r"\b(?:in\s+)?seconds?\b", "seconds"),
    (_I + r"\b(?:in\s+)?milliseconds?\b", "milliseconds"),
    (_I + r"\b(?:in\s+)?microseconds?\b", "microseconds"),
    (_I + r"\b(?:in\s+)?(?:milli)?meters?\b", "meters"),
    (_I + r"\b(?:in\s+)?centimeters?\b", "centimeters"),
    (_I + r"\b(?:in\s+)?millimeters?\b", "millimeters"),
    (_I + r"\b(?:in\s+)?microns?\b", "micrometers"),
    (_I + r"\b(?:in\s+)?micrometers?\b", "micrometers"),
    (_I + r"\b(?:in\s+)?kilograms?\b", "kilograms"),
    (_I + r"\b(?:in\s+)?grams?\b", "grams"),
    (_I + r"\b(?:in\s+)?pounds?\b", "pounds"),
    (_I + r"\b(?:in\s+)?hertz\b|\bHz\b", "hertz"),
    (_I + r"\b(?:in\s+)?(?:kilo)?hertz\b|\bkHz\b", "kilohertz"),
    (r"\b(?:in\s+)?tesla\b|\bT\b", "tesla"),
    (r"\b(?:in\s+)?volts?\b|\bV\b", "volts"),
    (r"\b(?:in\s+)?millivolts?\b|\bmV\b", "millivolts"),
    (_I + r"\b(?:in\s+)?degrees?\b", "degrees"),
    (_I + r"\b(?:in\s+)?radians?\b", "radians"),
    (_I + r"\b(?:in\s+)?percent(?:age)?\b|\b%\b", "percent"),
]
CORRECTED_UNITS = sorted(UNIT_PATTERNS, key=lambda p: -len(p[1]))
ISO_8601 = _I + r"\bISO\s*8601\b"
# Named formats and the patterns of their values.
FORMATS: list[tuple[str, str]] = [
    (ISO_8601, r"^P(\d+Y)?(\d+M)?(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"),
    (_I + r"\bRFC\s*3339\b|\bdatetime\b", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    (_I + r"\bUUID\b", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    (_I + r"\bDOI\b", r"^10\.\d{4,}"),
    (_I + r"\bORCID\b", r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"),
]
# Bounds named in a description.
LEAST = _I + r"\b(?:min(?:imum)?|at\s+least|>=?)\s*(\d+(?:\.\d+)?)"
MOST = _I + r"\b(?:max(?:imum)?|at\s+most|<=?|capped\s+at)\s*(\d+(?:\.\d+)?)"


def first_match(text: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that is found, else null. One pass over all of them tells the texts that none is found in."""
    head, *rest = table
    ordered = reduce(lambda c, p: c.when(text.rlike(p[0]), p[1]), rest, F.when(text.rlike(head[0]), head[1]))
    return F.when(text.rlike("|".join(f"(?:{p})" for p, _ in table)), ordered)


def unit(description: Column, name: Column | None = None, corrected: bool = False) -> Column:
    """The unit that a name and description speak of; ISO 8601 goes before all."""
    text = description if name is None else F.concat(F.coalesce(name, F.lit("")), F.lit(" "), description)
    return F.when(text.rlike(ISO_8601), "ISO8601").otherwise(first_match(text, CORRECTED_UNITS if corrected else UNIT_PATTERNS))


def pattern(description: Column) -> Column:
    return first_match(description, FORMATS)


def bounds(description: Column) -> tuple[Column, Column]:
    """Least and most value as doubles, null where not told."""
    return tuple(F.regexp_extract(description, p, 1).try_cast("double") for p in (LEAST, MOST))


def value_domain(data_type: Column, has_options: Column) -> Column:
    by_type = F.when(data_type == "string", "text").when(data_type.isin("integer", "float"), "numeric").when(data_type == "boolean", "boolean")
    return F.when(F.coalesce(has_options, F.lit(False)), "categorical").otherwise(by_type)


def ontology_prefix(uri: Column) -> Column:
    return F.when(uri.contains("/obo/"), F.lower(F.split(F.substring_index(uri, "/obo/", -1), "_")[0])).otherwise("unknown")


def ontology_prefix_aligned(uri: Column) -> Column:
    """The variant of alignment, which also knows schema.org and interlex."""
    return (
        F.when(uri.contains("/obo/"), F.lower(F.split(F.substring_index(uri, "/obo/", -1), "_")[0]))
        .when(uri.contains("schema.org"), "schema")
        .when(uri.contains("interlex"), "interlex")
        .otherwise("unknown")
    )


def obo_uri(text: Column) -> Column:
    """The first OBO term URI in a text, else null."""
    return F.nullif(F.regexp_extract(text, r"(http://purl\.obolibrary\.org/obo/\w+)", 1), F.lit(""))


def curie_to_uri(curie: Column) -> Column:
    return F.when(curie.startswith("http"), curie).otherwise(F.concat(F.lit("http://purl.obolibrary.org/obo/"), F.replace(curie, F.lit(":"), F.lit("_"))))


def clean_name(name: Column) -> Column:
    """A name as it is compared: lower case, underscores as blanks, trimmed."""
    return F.trim(F.replace(F.lower(name), F.lit("_"), F.lit(" ")))


def file_name(name: Column) -> Column:
    """A name made safe for files: lower case, separators and blanks as underscores, at most 100 characters."""
    return F.substring(F.translate(F.lower(name), "/\\ :", "____"), 1, 100)


def embedding_text(cls: Column, name: Column, description: Column, data_type: Column, unit_: Column, labels: Column, sources: Column) -> Column:
    """The text that stands for an element in an encoder: name, type and unit, up to five labels, sources if several."""
    named = F.concat_ws(" ", cls, name)
    head = F.when(F.coalesce(description, F.lit("")) != "", F.concat_ws(": ", named, description)).otherwise(named)
    many = F.array_sort(F.array_distinct(sources))
    return F.concat_ws(
        ". ",
        head,
        F.nullif(F.concat_ws(" ", data_type, unit_), F.lit("")),
        F.nullif(F.array_join(F.slice(labels, 1, 5), ", "), F.lit("")),
        F.when(F.size(many) > 1, F.array_join(many, ", ")),
    )


def search_text(name: Column, description: Column, data_type: Column, unit_: Column, labels: Column) -> Column:
    """The text that lexical search looks at."""
    return F.concat_ws(" ", name, F.substring(description, 1, 200), data_type, unit_, F.array_join(F.slice(labels, 1, 5), " "))
