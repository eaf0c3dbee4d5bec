"""All queries over the driver's tables and their SQL, by name."""

from . import operator_queries, reader_queries, registry_queries, structure_queries

QUERIES, ORACLES = registry_queries.QUERIES, registry_queries.ORACLES

__all__ = ["ORACLES", "QUERIES", "operator_queries", "reader_queries", "structure_queries"]
