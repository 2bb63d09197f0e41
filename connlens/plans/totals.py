"""The totals jobs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lattice import totals_by_lattice
from ..operators.totals import roll_up, tag_run, totals_all
from ..schemas import DEFAULT_TOTAL_TYPES, TOTAL_TYPES, TOTALS_SCHEMA
from ..session import configure
from ..sinks import read_results, write_results
from ..sources.tables import bucket_start, select_conn, select_touched

# Up to so many types a copy of each log row for each type costs less than further steps.
FEW_TYPES = 8


def run_totals(
    raw: DataFrame,
    since: str | datetime | None,
    run_ts: datetime,
    table: str,
    tipos: Sequence[str] = DEFAULT_TOTAL_TYPES,
    arrived: bool = False,
) -> None:
    """Compute the totals of the connections from the hour of ``since`` on and store them.

    The log is read once for all types; of more than a few, most are rolled up from the
    others' rows and not from the log. The hour is whole, and recorded in TS_FILTRO: a
    later run replaces totals of an hour by totals of the same hour.

    With ``arrived``, ``since`` is when the last run took place: the hours of records taken in since then, up to ``run_ts``, are
    counted anew, however old they are, and no others.
    """
    configure(raw.sparkSession)
    if arrived:
        rows = select_touched(raw, since, run_ts, "hour")
    else:
        rows = select_conn(raw, since, "hour")
    of = totals_by_lattice if len(tipos) > FEW_TYPES else totals_all
    _store(of(rows, tipos), since, run_ts, table)


def add_totals(
    spark: SparkSession,
    since: str | datetime | None,
    run_ts: datetime,
    table: str,
    source: str,
    tipos: Sequence[str],
) -> None:
    """Add further types to a stored run, rolled up from one of its types.

    ``source`` must group by every column the new types group by.
    """
    configure(spark)
    stored = read_results(spark, table, run_ts=run_ts)
    fine = stored.where(F.col("TIPO") == source)
    for tipo in tipos:
        if not set(TOTAL_TYPES[tipo]) < set(TOTAL_TYPES[source]):
            raise ValueError(f"{tipo} cannot be rolled up from {source}")
    _store(roll_up(fine, tipos), since, run_ts, table, add=True)


def _store(
    rows: DataFrame,
    since: str | datetime | None,
    run_ts: datetime,
    table: str,
    add: bool = False,
) -> None:
    tagged = tag_run(rows, bucket_start(since, "hour"), run_ts)
    columns = [c for c in TOTALS_SCHEMA.names if c != "ROW_ID"]
    write_results(tagged.select(*columns), table, run_ts, by=["TIPO"], add=add)
