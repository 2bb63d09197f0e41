"""DNS lookups and the connections that carried them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ENDPOINTS


def dns_www(dns: DataFrame) -> DataFrame:
    """Lookups of names with ``www.`` in them, sorted by name.

    The other columns break ties, so one very frequent name is spread over
    several sort partitions.
    """
    return (
        dns.select("UID", *ENDPOINTS, "QUERY")
        .where(F.col("QUERY").like("%www.%"))
        .orderBy("QUERY", "UID", *ENDPOINTS)
    )


def conn_by_dns_query(conn: DataFrame, lookups: DataFrame) -> DataFrame:
    """Connections joined to the names looked up over them, without duplicates.

    UID is the connection the lookup itself used, so the bytes are DNS traffic
    and not that of the visit that followed.

    Repeated lookups are dropped before the join, which keeps a UID with very
    many of them small. The join leaves the rows partitioned by UID, so the
    final ``distinct`` needs no further exchange.
    """
    names = lookups.select("UID", "QUERY").distinct()
    sides = ["PROTO", "SERVICE", "DURATION", "ORIG_BYTES", "RESP_BYTES"]
    return (
        conn.select("UID", *ENDPOINTS, *sides)
        .join(names, "UID")
        .select("UID", *ENDPOINTS, *sides, "QUERY")
        .distinct()
    )


def by_orig_bytes(rows: DataFrame) -> DataFrame:
    """Sort by ORIG_BYTES, largest first; the other columns break ties.

    Ties are many, as failed connections have no bytes at all.
    """
    others = [c for c in rows.columns if c not in ("ORIG_BYTES", "UID")]
    return rows.orderBy(F.desc("ORIG_BYTES"), "UID", *others)


def conn_www_sum(conn_www: DataFrame) -> DataFrame:
    """Duration and bytes by looked-up name, most answered bytes first."""
    return (
        conn_www.groupBy("QUERY")
        .agg(
            F.sum("DURATION").alias("DURATION"),
            F.sum("ORIG_BYTES").alias("ORIG_BYTES"),
            F.sum("RESP_BYTES").alias("RESP_BYTES"),
        )
        .orderBy(F.desc("RESP_BYTES"), "QUERY")
    )
