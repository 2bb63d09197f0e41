"""Hand-made connection rows and a way to compare frames."""

from datetime import datetime

from connlens.schemas import CONN_SCHEMA

DEFAULTS = {
    "TIPO": "CONN",
    "TS_CODE": datetime(2024, 1, 1),
    "TS": datetime(2024, 1, 1, 10, 30),
    "UID": "C1",
    "ID_ORIG_H": "10.0.0.1",
    "ID_ORIG_P": 40000,
    "ID_RESP_H": "200.18.0.1",
    "ID_RESP_P": 80,
    "PROTO": "tcp",
    "SERVICE": "http",
    "DURATION": 0.5,
    "ORIG_BYTES": 10,
    "RESP_BYTES": 20,
    "ORIG_PKTS": 1,
    "ORIG_IP_BYTES": 50,
    "RESP_PKTS": 2,
    "RESP_IP_BYTES": 60,
}


def conn_rows(spark, *rows):
    """Connections with the given values, and defaults for the rest."""
    filled = [{**DEFAULTS, **row} for row in rows]
    data = [tuple(row.get(n) for n in CONN_SCHEMA.names) for row in filled]
    return spark.createDataFrame(data, CONN_SCHEMA)


def as_set(df, *columns):
    """Rows as a multiset of tuples, in sorted order."""
    rows = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
    return sorted(rows, key=str)
