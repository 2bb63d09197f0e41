"""Merging the runs of a result table into a base, and reading base and later runs as one.

Beside the table's folder lies ``<table>.base`` with the bases, each in a folder of its own, and numbered manifests. A
manifest names the base that counts and the runs it holds; it is written under another name and renamed, so a reader
sees the one before or the one after, and of two compactions at once one fails. Merged runs are closed: a run is refused that is not
later than all of them, so base rows are older than those of any run beside it, and only new runs need a ranking.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = "RUN"


class CompactionConflict(RuntimeError):
    """Another compaction has switched the table meanwhile."""


@dataclass(frozen=True)
class Manifest:
    number: int
    base: str
    runs: tuple[str, ...]
    keys: tuple[str, ...]


def _side(path: str) -> str:
    return f"{path.rstrip('/')}.base"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and Hadoop's path class."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    files, as_path = _files(spark, path)
    folder = as_path(path)
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = _names(spark, _side(path))
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _manifest_path(path: str, number: int) -> str:
    return f"{_side(path)}/manifest-{number:08d}.json"


def read_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest that counts, or None for a table that has never been compacted."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    text = spark.read.text(_manifest_path(path, numbers[-1]), wholetext=True).first()["value"]
    stored = json.loads(text)
    return Manifest(numbers[-1], stored["base"], tuple(stored["runs"]), tuple(stored["keys"]))


def _publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    files, as_path = _files(spark, path)
    target = as_path(_manifest_path(path, manifest.number))
    draft = as_path(f"{_side(path)}/draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        content = {"base": manifest.base, "runs": manifest.runs, "keys": manifest.keys}
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    # A rename does not replace a file that is there.
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise CompactionConflict(f"manifest {manifest.number} of {path} exists")


def stored_runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs whose folders are there, in time order."""
    return sorted(n[len(RUN) + 1 :] for n in _names(spark, path) if n.startswith(f"{RUN}="))


def check_open(spark: SparkSession, path: str, run: str) -> None:
    """Refuse to write a run that merged rows would be newer than, or that is merged itself."""
    manifest = read_manifest(spark, path)
    if manifest and manifest.runs and run <= max(manifest.runs):
        raise ValueError(f"{run} is not later than the runs merged into the base of {path}")


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key; nulls in a key are equal. Each map task passes on one row per key only."""
    latest = Window.partitionBy(*keys).orderBy(F.desc("TS_CODE"), F.desc("ROW_ID"))
    placed = rows.withColumn("_place", F.row_number().over(latest))
    return placed.where(F.col("_place") == 1).drop("_place")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    found = F.lit(True)
    for key in keys:
        found = found & left[key].eqNullSafe(right[f"_{key}"])
    return found


def read_merged(
    spark: SparkSession, path: str, keys: Sequence[str], manifest: Manifest | None, since: str | None = None
) -> DataFrame:
    """The newest row per key of base and later runs, of runs from ``since`` on.

    Later runs are ranked; base rows stay unless a later run has their key. A base row tells its run, and as it is the
    newest of all merged runs, it is the newest of those since a time if its run is one of them.
    """
    later = [r for r in stored_runs(spark, path) if not manifest or r not in manifest.runs]
    wanted = [r for r in later if since is None or r >= since]
    parts = []
    if wanted:
        parts.append(newest(_runs(spark, path, wanted), keys))
    if manifest:
        base = spark.read.parquet(f"{_side(path)}/{manifest.base}")
        if since is not None:
            base = base.where(F.col(RUN) >= since)
        if parts:
            newer = parts[0].select(*[F.col(k).alias(f"_{k}") for k in keys])
            base = base.join(newer, _same(base, newer, keys), "left_anti")
        parts.append(base)
    if not parts:
        raise ValueError(f"no runs in {path}")
    return parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) > 1 else parts[0]


def _runs(spark: SparkSession, path: str, runs: Sequence[str]) -> DataFrame:
    """Rows of some runs, the run as a column. Runs without rows have no data files."""
    return spark.read.parquet(path).where(F.col(RUN).isin(list(runs)))


def compact_results(spark: SparkSession, path: str, keys: Sequence[str], by: Sequence[str] = ()) -> Manifest:
    """Write the newest row per key of all runs into a new base, and let it count from then on.

    ``by`` are the partition columns of the base. Runs written meanwhile stay beside it. The old base and the merged
    runs stay until :func:`vacuum_results`, for readers that have begun with them.
    """
    before = read_manifest(spark, path)
    if before and before.keys != tuple(keys):
        raise ValueError(f"the base of {path} has keys {list(before.keys)}")
    runs = stored_runs(spark, path)
    merged = tuple(sorted({*(before.runs if before else ()), *runs}))
    if before and merged == before.runs:
        return before
    rows = read_merged(spark, path, keys, before)
    name = f"base-{uuid.uuid4().hex}"
    writer = (rows.hint("rebalance", *by) if by else rows.hint("rebalance")).write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(f"{_side(path)}/{name}")
    manifest = Manifest(before.number + 1 if before else 1, name, merged, tuple(keys))
    _publish(spark, path, manifest)
    return manifest


def vacuum_results(spark: SparkSession, path: str) -> list[str]:
    """Remove what the manifest does not name: merged runs, older bases and manifests. Returns the folders removed.

    To be called when no reader that began before the last compaction is running.
    """
    manifest = read_manifest(spark, path)
    if manifest is None:
        return []
    files, as_path = _files(spark, path)
    old = [f"{path.rstrip('/')}/{RUN}={r}" for r in stored_runs(spark, path) if r in manifest.runs]
    side = _side(path)
    keep = {manifest.base, _manifest_path(path, manifest.number).rsplit("/", 1)[1]}
    old += [f"{side}/{name}" for name in _names(spark, side) if name not in keep]
    for target in old:
        files.delete(as_path(target), True)
    return old
