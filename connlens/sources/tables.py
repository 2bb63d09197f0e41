"""Reading stored tables and selecting the rows a job works on."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bucket, moment
from ..schemas import CONN
from .store import in_time, touched


def read_table(
    spark: SparkSession,
    location: str,
    source: str = "parquet",
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Load a table by path, or by catalog name with ``source='table'``.

    ``source`` is any batch source of the session (parquet, orc, csv, json,
    jdbc, or a connector on its class path), with its own ``options``.
    """
    if source == "table":
        return spark.table(location)
    reader = spark.read.format(source).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    # Connectors addressed by options alone (such as jdbc) take no path.
    return reader.load(location) if location else reader.load()


def later_than(column: str, since: str | datetime) -> Column:
    """``column > since`` on timestamps."""
    return F.col(column) > moment(since)


def select_recent(raw: DataFrame, since: str | datetime) -> DataFrame:
    """All records taken in after ``since``."""
    return in_time(raw, "TS_CODE", after=since)


def select_conn(
    raw: DataFrame, since: str | datetime | None = None, whole: str | None = None
) -> DataFrame:
    """Connection records of events after ``since``.

    With ``whole``, a time bucket, they begin with the start of the bucket that
    ``since`` is in, so that no bucket is counted in part.
    """
    conn = raw.where(F.col("TIPO") == CONN)
    if since is None:
        return conn
    if whole is None:
        return in_time(conn, "TS", after=since)
    return in_time(conn, "TS", start=bucket_start(since, whole))


def select_touched(
    raw: DataFrame, after: str | datetime, until: str | datetime, whole: str
) -> DataFrame:
    """Connection records of the buckets that late or new ones, taken in after ``after``, belong to."""
    return touched(raw.where(F.col("TIPO") == CONN), after, until, whole)


def bucket_start(since: str | datetime | None, grain: str) -> Column:
    """Start of the bucket that a point in time is in; null for none."""
    return bucket(grain, moment(since))


def select_results(table: DataFrame, since: str | datetime, tipo: str) -> DataFrame:
    """Rows of one type without a COUNT, that is records rather than totals."""
    return table.where(
        (F.col("TIPO") == tipo) & later_than("TS_CODE", since) & F.col("COUNT").isNull()
    )


def select_totals(
    totals: DataFrame, since: str | datetime, tipo: str | None = None
) -> DataFrame:
    """Totals written after ``since``, of one type or of all."""
    recent = totals.where(later_than("TS_CODE", since))
    return recent if tipo is None else recent.where(F.col("TIPO") == tipo)


def select_scores(scores: DataFrame, since: str | datetime) -> DataFrame:
    """Scored detection rows written after ``since``."""
    return scores.where(later_than("TS_CODE", since))
