"""Rankings of hosts and connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_conn_by_bytes(conn: DataFrame, n: int = 100) -> DataFrame:
    """The connections that sent most bytes; UID breaks ties."""
    return conn.orderBy(F.desc("ORIG_BYTES"), "UID").limit(n)


def inbound_to_prefix(totals: DataFrame, prefix: str) -> DataFrame:
    """Host-pair totals with a target address of the given prefix."""
    pairs = totals.where(F.col("TIPO") == "ORIG_H_RESP_H")
    return pairs.where(F.col("ID_RESP_H").startswith(prefix))


def responder_totals(totals: DataFrame) -> DataFrame:
    """The totals by protocol, service and target host."""
    return totals.where(F.col("TIPO") == "PROTO_SERVICE_RESP_H")


def resp_h_ranking(totals: DataFrame) -> DataFrame:
    """All target hosts, those with most connections first."""
    return _ranking(responder_totals(totals), "ID_RESP_H")


def orig_h_ranking(totals: DataFrame, prefix: str) -> DataFrame:
    """All source hosts with connections into the prefix, those with most first."""
    return _ranking(inbound_to_prefix(totals, prefix), "ID_ORIG_H")


def _ranking(rows: DataFrame, host: str) -> DataFrame:
    return (
        rows.groupBy(host)
        .agg(F.sum("COUNT").alias("COUNT"))
        .orderBy(F.desc("COUNT"), host)
    )
