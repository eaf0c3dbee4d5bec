"""What extractions of known sources are expected to hold: counts by type, types by category, entities that have to be there."""

from __future__ import annotations

_FIELDS = {"attribute": ["data_type"], "enum_value": ["label"]}
# Least and most entities of each type, the type that each category gives, and known entities (class, name, type).
_COUNTS = {
    "bids": {"attribute": (400, 600), "enum_value": (200, 500), "valueset": (5, 30), "class": (5, 20)},
    "dandi": {"attribute": (200, 500), "enum_value": (80, 200), "valueset": (10, 40), "class": (20, 50)},
    "nwb": {"attribute": (200, 500), "class": (50, 150)},
    "openminds": {"attribute": (2000, 6000), "valueset": (50, 150), "class": (100, 400)},
    "aind": {"attribute": (800, 2000), "enum_value": (200, 800), "valueset": (30, 100), "class": (50, 200)},
}
_CATEGORIES = {"bids": {"enums": "enum_value", "datatypes": "enum_value", "modalities": "enum_value", "suffixes": "enum_value", "extensions": "enum_value", "metadata": "attribute", "columns": "attribute"}}
_KNOWN = {
    "bids": [
        ("columns", "age", "attribute"), ("columns", "sex", "attribute"), ("metadata", "RepetitionTime", "attribute"), ("metadata", "TaskName", "attribute"), ("enums", "CASL", "enum_value"),
        ("enums", "left_hemisphere", "enum_value"), ("suffixes", "T1w", "enum_value"), ("suffixes", "bold", "enum_value"), ("datatypes", "anat", "enum_value"),
    ],
    "dandi": [("Dandiset", "name", "attribute"), ("Dandiset", "description", "attribute"), ("Person", "Person", "class"), ("Organization", "Organization", "class")],
    "nwb": [("TimeSeries", "TimeSeries", "class"), ("NWBFile", "NWBFile", "class"), ("ElectricalSeries", "ElectricalSeries", "class")],
    "openminds": [("", "Person", "class"), ("", "BiologicalSex", "valueset"), ("", "Species", "valueset")],
    "aind": [("", "Subject", "class"), ("", "Sex", "valueset")],
}
#: Sources whose values carry no label that could be missing.
_WITHOUT_VALUES = ("nwb", "openminds")


def spec_of(source: str) -> dict:
    """The spec of a known source; KeyError for others."""
    return {
        "expected_types": {t: {"min": a, "max": z} for t, (a, z) in _COUNTS[source].items()}, "category_rules": _CATEGORIES.get(source, {}),
        "known_entities": [{"class": c, "name": n, "type": t} for c, n, t in _KNOWN[source]],
        "required_fields": {t: f for t, f in _FIELDS.items() if t != "enum_value" or source not in _WITHOUT_VALUES},
    }
