"""Calendar buckets of the event time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms of a bucket in exported files.
BUCKET_FORMATS = {
    "minute": "dd.MM.yyyy HH:mm",
    "hour": "dd.MM.yyyy HH",
    "day": "dd.MM.yyyy",
}


def moment(value: str | datetime | Column | None) -> Column:
    """A point in time as a literal, read in the session's time zone.

    A datetime goes through its text: as a literal of its own it would be read
    in the time zone of the machine that runs the driver. A column stays as it is.
    """
    if isinstance(value, Column):
        return value
    return F.lit(None if value is None else str(value)).cast("timestamp")


def bucket(grain: str, ts: str | Column = "TS") -> Column:
    """Start of the minute, hour or day of ``ts``, as a timestamp.

    The value stays a timestamp, so it sorts by time and keeps the two equal
    wall-clock hours of a clock change apart.
    """
    if grain not in BUCKET_FORMATS:
        raise ValueError(f"unknown time bucket {grain!r}")
    return F.date_trunc(grain, ts)


def bucket_text(grain: str, ts: str | Column = "TS") -> Column:
    """The bucket as export text; to be used after sorting, never before."""
    return F.date_format(ts, BUCKET_FORMATS[grain])


def bucket_from_text(grain: str, text: str | Column = "TS") -> Column:
    """The bucket of an export text; null where it is not of that form."""
    column = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(column, F.lit(BUCKET_FORMATS[grain]))
