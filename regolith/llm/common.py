"""What the operators of this subpackage share: word sets, the shared folder, bounded Arrow output."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from regolith.operators.graph import materialised as written
from regolith.operators.graph import shared_dir

__all__ = ["BATCH_BYTES", "ascii_lower", "arrow_kind", "byte_words", "if_small", "in_batches", "shared_dir", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Output batches are cut at about this many bytes, whatever the rows weigh.
BATCH_BYTES = 8 << 20
#: Narrow rows are broadcast only when counted to be so few.
BROADCAST_ROWS = 1_000_000

def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and no other letter; null stays null."""
    return F.translate(text, UPPER, LOWER)


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= most else df


def arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type in which Spark hands a column to Python."""
    return to_arrow_type(df.schema[column].dataType)


def byte_words(text: str | None) -> list[bytes]:
    """The words between spaces and the controls 9 to 13, A-Z lower-cased.

    bytes.lower and bytes.split know ASCII only, which is just this rule.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def in_batches(rows: Iterable[tuple], schema: pa.Schema, weigh=lambda row: 256, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded weight."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
