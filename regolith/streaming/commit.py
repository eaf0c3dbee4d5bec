"""Incremental commit: every micro-batch of staged entities is merged by hash into the registry table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from regolith.operators.table_log import TableLog


def commit_stream(staged: DataFrame, table: TableLog, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the commit of a stream into a table. A batch is named by its number, so that one that is delivered again is applied once."""

    def merge(batch: DataFrame, no: int) -> None:
        TableLog(batch.sparkSession, table.path).merge(batch, f"stream-{no}")

    writer = staged.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
