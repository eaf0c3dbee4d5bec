"""Times as expressions; what time it is now is always the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(at: Column) -> Column:
    """A timestamp as ISO 8601 in UTC; the session's time zone has to be UTC, as this project's sessions are."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stale(at: Column, now: Column, hours: float) -> Column:
    """Whether a time lies more than so many hours back; a null time is stale."""
    return F.coalesce((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) > hours * 3600, F.lit(True))


def nightly_version(at: Column) -> Column:
    return F.concat(F.lit("nightly-"), F.date_format(at, "yyyy-MM-dd"))
