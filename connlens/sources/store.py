"""The log as a stored table, partitioned so that a bound in time names the folders to read.

Below the record kind a record lies under the day of its event (DAY) and the day it was taken in (ARRIVED). A bound on TS
is a range of DAY, one on TS_CODE a range of ARRIVED; a late record adds a folder of its own day, so no bound on how
late it may be is needed for either.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bucket, lookup_join, moment
from ..session import materialize

DAY, ARRIVED = "DAY", "ARRIVED"
_DAY_OF = {"TS": DAY, "TS_CODE": ARRIVED}


def ingest(rows: DataFrame, path: str) -> None:
    """Append records to the stored log.

    The rebalance gathers the records of a folder into files of a good size, and cuts those of a busy day up.
    """
    dated = rows.withColumns({day: F.to_date(column) for column, day in _DAY_OF.items()})
    spread = dated.hint("rebalance", "TIPO", DAY, ARRIVED)
    spread.write.mode("append").partitionBy("TIPO", DAY, ARRIVED).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def in_time(
    rows: DataFrame,
    column: str,
    after: str | datetime | Column | None = None,
    until: str | datetime | Column | None = None,
    start: str | datetime | Column | None = None,
) -> DataFrame:
    """Rows with ``column`` later than ``after``, not later than ``until`` and not before ``start``.

    Of a log with days as partitions only the days in question are read.
    """
    day = _DAY_OF.get(column)
    dated = day in rows.columns
    for bound, low in ((after, True), (start, True), (until, False)):
        if bound is None:
            continue
        at = moment(bound)
        if dated:
            edge = F.to_date(at)
            rows = rows.where(F.col(day) >= edge if low else F.col(day) <= edge)
        own = F.col(column)
        rows = rows.where(own > at if bound is after else own >= at if bound is start else own <= at)
    return rows


def touched(
    log: DataFrame, after: str | datetime, until: str | datetime, grain: str
) -> DataFrame:
    """All records, taken in up to ``until``, of the time buckets that have one taken in later than ``after``.

    Only the days of these buckets are read. The driver gets a date for each of these days; the buckets themselves are joined
    by their measured size.
    """
    fresh = in_time(log, "TS_CODE", after=after, until=until)
    buckets = materialize(fresh.select(bucket(grain).alias("_bucket")).where("_bucket IS NOT NULL").distinct())
    known = in_time(log, "TS_CODE", until=until)
    if DAY in log.columns:
        days = buckets.select(F.to_date("_bucket").alias("day")).distinct().collect()
        known = known.where(F.col(DAY).isin([row["day"] for row in days]))
    marked = known.withColumn("_bucket", bucket(grain))
    return lookup_join(marked, buckets, ["_bucket"], "left_semi").drop("_bucket")
