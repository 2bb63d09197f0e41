"""Result tables: Parquet, partitioned by run, newest row per key on read."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.totals import with_row_id
from .compaction import RUN, check_open, newest, read_manifest, read_merged


def run_name(run_ts: datetime) -> str:
    """Partition value of a run. Names sort by time."""
    return run_ts.strftime("run-%Y%m%dT%H%M%S.%f")


def write_results(
    rows: DataFrame,
    path: str,
    run_ts: datetime,
    by: Sequence[str] = (),
    add: bool = False,
) -> None:
    """Write the rows of one run, replacing all that the same run has stored.

    ``by`` are further partition columns, below the run's folder. With ``add``
    only the partitions written are replaced, and the run's others stay. The
    rebalance gathers each partition into files of a good size and cuts large ones
    up. ROW_ID comes after it, in the writing task, so a task that runs again replaces its
    whole file and no id occurs twice. An empty result leaves a run without
    rows; with ``by`` it writes no data files. A run that is merged into a base, or
    earlier than one that is, is refused.
    """
    check_open(rows.sparkSession, path, run_name(run_ts))
    spread = rows.hint("rebalance", *by) if by else rows.hint("rebalance")
    writer = with_row_id(spread).write.mode("overwrite")
    if by:
        replaced = "dynamic" if add else "static"
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", replaced)
    writer.parquet(f"{path.rstrip('/')}/{RUN}={run_name(run_ts)}")


def read_results(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] | None = None,
    run_ts: datetime | None = None,
    since: datetime | None = None,
    all_runs: bool = False,
) -> DataFrame:
    """Read a result table: one run of it, or the newest row per key.

    With ``run_ts`` only that run's partitions are read, with ``since`` only those of
    runs from then on. With ``keys`` a row of a later run replaces the earlier one with
    the same key; nulls in a key are equal. Each map task passes on one row per key
    only. Runs may overlap, so rows of several without ``keys`` must be asked
    for by ``all_runs``.

    Of a compacted table, rows by the keys of its base come from the base and the runs after it;
    other reads need the runs' own folders.
    """
    if keys is None and run_ts is None and not all_runs:
        raise ValueError("runs may overlap: give keys, run_ts or all_runs=True")
    if keys is not None and run_ts is None:
        manifest = read_manifest(spark, path)
        if manifest and set(manifest.keys) == set(keys):
            return read_merged(spark, path, keys, manifest, since and run_name(since)).drop(RUN)
    table = spark.read.parquet(path)
    if run_ts is not None:
        table = table.where(F.col(RUN) == run_name(run_ts))
    if since is not None:
        table = table.where(F.col(RUN) >= run_name(since))
    if keys is not None:
        table = newest(table, keys)
    return table.drop(RUN)


def append_ip_info(rows: DataFrame, path: str) -> None:
    """Append newly looked-up addresses to the stored IP_INFO table."""
    rows.write.mode("append").parquet(path)
