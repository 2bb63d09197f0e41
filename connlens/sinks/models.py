"""Stored centres of the detection, one folder per service or protocol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.clusters import centres_of

CENTRES = "centres"


def save_model(spark: SparkSession, centres: Sequence[float], path: str) -> None:
    """Save ascending centres, replacing those that are there."""
    row = spark.createDataFrame([(list(map(float, centres)),)], "CENTRES array<double>")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/{CENTRES}")


def load_model(spark: SparkSession, path: str) -> list[float]:
    """The ascending centres saved in a folder, or those of a k-means model that Spark ML has saved there."""
    stored = _stored(spark, path)
    if stored is not None:
        return list(stored.first()["CENTRES"])
    return centres_of(KMeansModel.load(path))


def has_model(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a saved model."""
    return _stored(spark, path) is not None or _found(lambda: spark.read.text(f"{path}/metadata")) is not None


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return _found(lambda: spark.read.schema("CENTRES array<double>").parquet(f"{path}/{CENTRES}"))


def _found(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
