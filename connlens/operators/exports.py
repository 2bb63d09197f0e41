"""Row order and form of the exported totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_text
from ..schemas import NOT_EXPORTED, TOTAL_TYPES

EXPORTED = [tipo for tipo in TOTAL_TYPES if tipo not in NOT_EXPORTED]


def totals_export(totals: DataFrame, tipo: str) -> DataFrame:
    """Totals of one type, sorted by hour and every grouping column.

    The sort key is unique, so the rows of one busy hour can be spread over
    several sort partitions, and the order is the same in every run.
    """
    return totals.where(F.col("TIPO") == tipo).orderBy("TS", *TOTAL_TYPES[tipo])


def busiest_first(totals: DataFrame, tipo: str) -> DataFrame:
    """Totals of one type by COUNT, largest first.

    Small counts are equal very often, even within an hour and host: the hour
    and all grouping columns make the sort key unique.
    """
    return totals.orderBy(F.desc("COUNT"), "TS", *TOTAL_TYPES[tipo])


def with_text_centres(scored: DataFrame) -> DataFrame:
    """Write all centres of a scored row as plain number texts."""
    return scored.withColumn("CENTROID", F.col("CENTROID").cast("array<string>"))


def with_text_time(rows: DataFrame, grain: str) -> DataFrame:
    """Write TS as text of the given grain; to be used after sorting."""
    return rows.withColumn("TS", bucket_text(grain))
