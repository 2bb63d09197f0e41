"""Aggregates every total and feature table has in common."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MEASURES


def count_rows() -> Column:
    return F.count(F.lit(1)).alias("COUNT")


def sum_counts() -> Column:
    return F.sum("COUNT").alias("COUNT")


def sum_measures() -> list[Column]:
    return [F.sum(name).alias(name) for name in MEASURES]
