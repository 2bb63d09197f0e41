"""Extract of the raw records and of the traffic behind looked-up names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from ..operators.dns import by_orig_bytes, conn_by_dns_query, conn_www_sum, dns_www
from ..session import configure, materialize
from ..sinks import preview, write_csv
from ..sources.records import conn_records, dns_records, http_records
from ..sources.tables import select_recent


def extract(raw: DataFrame, since: str | datetime, out: str) -> None:
    """Write CONN-ALL, DNS-ALL, HTTP-ALL, CONN-WWW and CONN-WWW-SUM as CSV.

    Each extract filters on TIPO, which prunes a raw log partitioned by it.
    """
    configure(raw.sparkSession)
    recent = select_recent(raw, since)
    conn = conn_records(recent)
    dns = dns_records(recent)
    write_csv(conn, f"{out}/CONN-ALL")
    write_csv(dns, f"{out}/DNS-ALL")
    write_csv(http_records(recent), f"{out}/HTTP-ALL")

    joined = materialize(conn_by_dns_query(conn, dns_www(dns)))
    write_csv(by_orig_bytes(joined), f"{out}/CONN-WWW")
    write_csv(conn_www_sum(joined), f"{out}/CONN-WWW-SUM")


def inspect(raw: DataFrame, since: str | datetime, title: str = "NEW") -> None:
    """Print count, schema and first rows of the recent records."""
    preview(select_recent(raw, since), title)
