"""Feature tables of the DDoS and the port-scan detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bucket, count_rows, sum_measures
from ..schemas import DDOS_KEYS, MEASURES, SCAN_KEYS


def ddos_features(conn: DataFrame, services: Sequence[str]) -> DataFrame:
    """Per minute, source, target and target port: row count and seven sums.

    Several services take one pass; SERVICE is part of the key.
    """
    return _features(conn, "SERVICE", services, DDOS_KEYS, "minute")


def scan_features(conn: DataFrame, protos: Sequence[str]) -> DataFrame:
    """Per hour, source, source port and target: row count and seven sums.

    Several protocols take one pass; PROTO is part of the key. Target ports are
    neither grouped by nor counted.
    """
    return _features(conn, "PROTO", protos, SCAN_KEYS, "hour")


def _features(
    conn: DataFrame, column: str, kinds: Sequence[str], keys: list[str], grain: str
) -> DataFrame:
    return (
        conn.where(F.col(column).isin(*kinds))
        .groupBy(*keys, bucket(grain).alias("TS"))
        .agg(count_rows(), *sum_measures())
        .select(*keys, "TS", "COUNT", *MEASURES)
    )
