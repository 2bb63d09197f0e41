"""Hourly totals of connections, by any of the total types."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket, case, count_rows, moment, sum_counts, sum_measures
from ..schemas import DEFAULT_TOTAL_TYPES, GROUP_COLUMNS, MEASURES, TOTAL_TYPES

TOTAL_COLUMNS = ["TIPO", "TS"] + GROUP_COLUMNS + ["COUNT"] + MEASURES


def totals(conn: DataFrame, tipo: str) -> DataFrame:
    """Totals of one type: per hour and group, the row count and seven sums.

    Rows combine on the map side, so a hot group reaches its reducer as one
    row per map task.
    """
    keys = TOTAL_TYPES[tipo]
    return (
        conn.groupBy(bucket("hour").alias("TS"), *keys)
        .agg(count_rows(), *sum_measures())
        .select(F.lit(tipo).alias("TIPO"), "TS", *keys, "COUNT", *MEASURES)
    )


def totals_all(conn: DataFrame, tipos: Sequence[str] = DEFAULT_TOTAL_TYPES) -> DataFrame:
    """Totals of several types in one pass over the connections.

    Rows combine on the map side here as well: a coarse type adds next to
    nothing to the shuffle, and a hot group is one row per map task.
    The result has every grouping column; those a type does not group by are
    null. TIPO tells such a null from a missing value of the log.
    """
    hourly = conn.withColumn("TS", bucket("hour"))
    return _grouping_sets(hourly, tipos, count_rows())


def roll_up(fine: DataFrame, tipos: Sequence[str]) -> DataFrame:
    """Totals of coarser types out of the stored totals of one finer type.

    Counts and sums add up, so the log itself is not read again.
    """
    return _grouping_sets(fine, tipos, sum_counts())


def _grouping_sets(rows: DataFrame, tipos: Sequence[str], count: Column) -> DataFrame:
    unknown = [t for t in tipos if t not in TOTAL_TYPES]
    if unknown or not tipos:
        raise ValueError(f"unknown total types {unknown}" if unknown else "no total type")
    used = [c for c in GROUP_COLUMNS if any(c in TOTAL_TYPES[t] for t in tipos)]
    grouped = rows.groupingSets(
        [["TS", *TOTAL_TYPES[t]] for t in tipos], "TS", *used
    ).agg(F.grouping_id().alias("_set"), count, *sum_measures())
    columns = [
        F.col(c) if c in used else F.lit(None).cast(rows.schema[c].dataType).alias(c)
        for c in GROUP_COLUMNS
    ]
    tipo = _tipo_of_set(tipos, used).alias("TIPO")
    return grouped.select(tipo, "TS", *columns, "COUNT", *MEASURES)


def _tipo_of_set(tipos: Sequence[str], used: Sequence[str]) -> Column:
    """Total type of a grouping id: one bit per column, set where it is absent."""
    absent_bits = {
        tipo: sum(
            2 ** (len(used) - 1 - place)
            for place, column in enumerate(used)
            if column not in TOTAL_TYPES[tipo]
        )
        for tipo in tipos
    }
    return case((F.col("_set") == bits, tipo) for tipo, bits in absent_bits.items())


def tag_run(
    rows: DataFrame, since: str | datetime | Column | None, run_ts: str | datetime
) -> DataFrame:
    """Add the run's selection start (TS_FILTRO) and its own time (TS_CODE)."""
    return rows.withColumns(
        {
            "TS_FILTRO": moment(since),
            "TS_CODE": moment(run_ts),
        }
    )


def with_row_id(rows: DataFrame) -> DataFrame:
    """Add the surrogate ROW_ID.

    It counts from 0 in every frame, so it is a key only together with TIPO and
    TS_CODE. Add it last before a write: its values depend on how the rows are
    spread over tasks.
    """
    return rows.withColumn("ROW_ID", F.monotonically_increasing_id())
