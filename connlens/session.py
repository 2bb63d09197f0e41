"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. Each can be changed at run time on any session.
SETTINGS = {
    # Hours and days are calendar buckets of UTC on every cluster.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split over several tasks, even where that costs one
    # more exchange for the operator above the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """A new sub-folder path of the folder in ``spark.checkpoint.dir``.

    Executors on other machines must see the folder, so only a local session
    may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="connlens-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/connlens-{uuid.uuid4().hex}"


def materialize(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write a frame to the scratch folder as Parquet and read it back.

    For frames used by several later steps: the work is done once, the lineage
    ends at files that outlive any executor, and later filters and column
    choices reach the scan. With ``by`` a filter on these columns names the folders to read.
    """
    path = scratch_folder(df.sparkSession)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
