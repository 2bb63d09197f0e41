"""Histories over time, as long tables and pivoted."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bucket, lookup_join, sum_counts
from ..session import materialize
from .clusters import victims


def history(rows: DataFrame, column: str, grain: str | None = None) -> DataFrame:
    """COUNT by time and one column; without a grain, at the rows' own time."""
    ts = F.col("TS") if grain is None else bucket(grain)
    return rows.groupBy(ts.alias("TS"), column).agg(sum_counts())


def spread(
    long: DataFrame,
    column: str,
    values: Sequence[Any] | None = None,
    plain_names: bool = False,
) -> DataFrame:
    """A history with one column per value, sorted by time.

    ``values`` chooses the columns. Without it every value is one: Spark finds
    them first, in a job of its own over ``long``, and refuses more than
    ``spark.sql.pivotMaxValues``; ``long`` has the same numbers for any number
    of values. ``plain_names`` writes the dots of an address as underscores,
    for readers that take a dot for a field access.
    """
    if plain_names:
        long = long.withColumn(column, F.translate(column, ".", "_"))
        values = values and [str(v).replace(".", "_") for v in values]
    pivoted = long.groupBy("TS").pivot(column, values and list(values))
    return pivoted.agg(sum_counts()).orderBy("TS")


def pivot(
    rows: DataFrame,
    column: str,
    grain: str | None = None,
    values: Sequence[Any] | None = None,
    plain_names: bool = False,
) -> DataFrame:
    """COUNT by time (rows) and the values of one column (columns).

    Without ``values`` the short history is written to the scratch folder
    first, so that finding them does not read the rows a second time.
    """
    long = history(rows, column, grain)
    if values is None:
        long = materialize(long)
    return spread(long, column, values, plain_names)


def victim_counts(
    scored: DataFrame, kind_column: str, grain: str | None = None
) -> DataFrame:
    """History of the victims of one kind by target host.

    Rows are added up before the victims are picked, so the join sees one row
    per time and host and not all rows of a hot host.
    """
    hosts = victims(scored, kind_column).select("ID_RESP_H").distinct()
    long = history(scored, "ID_RESP_H", grain)
    return lookup_join(long, hosts, ["ID_RESP_H"], "left_semi")
