"""Record extracts: the columns of one record kind out of the wide raw log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CONN, CONN_SCHEMA, DNS, DNS_SCHEMA, HTTP, HTTP_SCHEMA


def _records(
    raw: DataFrame, kind: str, schema: T.StructType, extra: Sequence[str]
) -> DataFrame:
    return raw.where(F.col("TIPO") == kind).select(*schema.names, *extra)


def conn_records(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Connection records."""
    return _records(raw, CONN, CONN_SCHEMA, extra)


def dns_records(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """DNS records."""
    return _records(raw, DNS, DNS_SCHEMA, extra)


def http_records(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """HTTP records."""
    return _records(raw, HTTP, HTTP_SCHEMA, extra)
