"""Column names, table schemas and the total types.

Fixed values: the column names, the record kinds and the 23 total types below
are part of the data model, so results are only comparable with these spellings.
"""

from __future__ import annotations

from pyspark.sql import types as T

CONN, DNS, HTTP = "CONN", "DNS", "HTTP"

ENDPOINTS = ["ID_ORIG_H", "ID_ORIG_P", "ID_RESP_H", "ID_RESP_P"]

# Summed per group by every total and every feature table.
MEASURES = [
    "DURATION",
    "ORIG_IP_BYTES",
    "RESP_IP_BYTES",
    "ORIG_PKTS",
    "ORIG_BYTES",
    "RESP_PKTS",
    "RESP_BYTES",
]


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def _struct(columns: str) -> T.StructType:
    # Spark's own DDL reader needs a running session, an import must not.
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


COMMON_SCHEMA = _struct(
    "TIPO string, TS_CODE timestamp, TS timestamp, UID string, ID_ORIG_H string, "
    "ID_ORIG_P int, ID_RESP_H string, ID_RESP_P int, PROTO string"
)

CONN_SCHEMA = T.StructType(
    COMMON_SCHEMA.fields
    + _struct(
        "SERVICE string, DURATION double, ORIG_BYTES bigint, RESP_BYTES bigint, "
        "CONN_STATE string, LOCAL_ORIG boolean, LOCAL_RESP boolean, "
        "MISSED_BYTES bigint, HISTORY string, ORIG_PKTS bigint, "
        "ORIG_IP_BYTES bigint, RESP_PKTS bigint, RESP_IP_BYTES bigint"
    ).fields
)

DNS_SCHEMA = T.StructType(
    COMMON_SCHEMA.fields
    + _struct(
        "TRANS_ID int, QUERY string, QCLASS int, QCLASS_NAME string, QTYPE int, "
        "QTYPE_NAME string, RCODE int, RCODE_NAME string, AA boolean, TC boolean, "
        "RD boolean, RA boolean, Z int, REJECTED boolean"
    ).fields
)

HTTP_SCHEMA = T.StructType(
    COMMON_SCHEMA.fields
    + _struct(
        "TRANS_DEPTH int, VERSION string, REQUEST_BODY_LEN bigint, "
        "RESPONSE_BODY_LEN bigint, STATUS_CODE int, STATUS_MSG string"
    ).fields
)

# Array columns of the raw log, left out of the extracts unless asked for:
# a CSV file cannot hold them.
ARRAY_COLUMNS = _struct(
    "TUNNEL_PARENTS array<string>, ANSWERS array<string>, TTLS array<double>, "
    "TAGS array<string>, RESP_FUIDS array<string>, RESP_MIME_TYPES array<string>"
)

# The raw log is one wide table: TIPO tells the record kinds apart.
RAW_SCHEMA = T.StructType(
    COMMON_SCHEMA.fields
    + CONN_SCHEMA.fields[len(COMMON_SCHEMA) :]
    + DNS_SCHEMA.fields[len(COMMON_SCHEMA) :]
    + HTTP_SCHEMA.fields[len(COMMON_SCHEMA) :]
    + ARRAY_COLUMNS.fields
)

IP_INFO_SCHEMA = _struct(
    "IP string, HOSTNAME string, CITY string, REGION string, COUNTRY string, "
    "ORG string, LATITUDE double, LONGITUDE double, TS_CODE timestamp"
)

# Grouping columns of a total, in the order of every totals table.
GROUP_COLUMNS = ["PROTO", "SERVICE"] + ENDPOINTS

_SUMS = (
    "COUNT bigint, DURATION double, ORIG_IP_BYTES bigint, RESP_IP_BYTES bigint, "
    "ORIG_PKTS bigint, ORIG_BYTES bigint, RESP_PKTS bigint, RESP_BYTES bigint"
)
_RUN_TAGS = "TS_FILTRO timestamp, TS_CODE timestamp, ROW_ID bigint"

TOTALS_SCHEMA = _struct(
    "TIPO string, TS timestamp, PROTO string, SERVICE string, ID_ORIG_H string, "
    f"ID_ORIG_P int, ID_RESP_H string, ID_RESP_P int, {_SUMS}, {_RUN_TAGS}"
)

_SCORES = f"{_SUMS}, {_RUN_TAGS}, PREDICTION int, CENTRE double, CENTROID array<double>"

DDOS_SCHEMA = _struct(
    "ID_ORIG_H string, ID_RESP_H string, ID_RESP_P int, PROTO string, "
    f"SERVICE string, TS timestamp, {_SCORES}"
)

SCAN_SCHEMA = _struct(
    "ID_ORIG_H string, ID_ORIG_P int, ID_RESP_H string, PROTO string, "
    f"TS timestamp, {_SCORES}"
)

# Total type -> grouping columns besides the hour.
TOTAL_TYPES: dict[str, list[str]] = {
    "PROTO": ["PROTO"],
    "PROTO_SERVICE": ["PROTO", "SERVICE"],
    "PROTO_SERVICE_ORIG_H": ["PROTO", "SERVICE", "ID_ORIG_H"],
    "PROTO_SERVICE_ORIG_P": ["PROTO", "SERVICE", "ID_ORIG_P"],
    "PROTO_SERVICE_RESP_H": ["PROTO", "SERVICE", "ID_RESP_H"],
    "PROTO_SERVICE_RESP_P": ["PROTO", "SERVICE", "ID_RESP_P"],
    "ORIG_H_RESP_H": ["ID_ORIG_H", "ID_RESP_H"],
    "PROTO_ORIG_H": ["PROTO", "ID_ORIG_H"],
    "PROTO_ORIG_H_P": ["PROTO", "ID_ORIG_H", "ID_ORIG_P"],
    "PROTO_RESP_H": ["PROTO", "ID_RESP_H"],
    "PROTO_RESP_H_P": ["PROTO", "ID_RESP_H", "ID_RESP_P"],
    "SERVICE": ["SERVICE"],
    "PROTO_SERVICE_ORIG_H_P": ["PROTO", "SERVICE", "ID_ORIG_H", "ID_ORIG_P"],
    "PROTO_SERVICE_RESP_H_P": ["PROTO", "SERVICE", "ID_RESP_H", "ID_RESP_P"],
    "ORIG_H": ["ID_ORIG_H"],
    "ORIG_P": ["ID_ORIG_P"],
    "ORIG_H_P": ["ID_ORIG_H", "ID_ORIG_P"],
    "ORIG_H_P_RESP_H": ["ID_ORIG_H", "ID_ORIG_P", "ID_RESP_H"],
    "RESP_H": ["ID_RESP_H"],
    "RESP_P": ["ID_RESP_P"],
    "RESP_H_P": ["ID_RESP_H", "ID_RESP_P"],
    "RESP_H_P_ORIG_H": ["ID_RESP_H", "ID_RESP_P", "ID_ORIG_H"],
    "ORIG_H_P_RESP_H_P": ENDPOINTS,
}

# The types a totals run computes unless told otherwise.
DEFAULT_TOTAL_TYPES = [
    "PROTO",
    "PROTO_SERVICE",
    "PROTO_SERVICE_ORIG_H",
    "PROTO_SERVICE_ORIG_P",
    "PROTO_SERVICE_RESP_H",
    "PROTO_SERVICE_RESP_P",
    "ORIG_H_RESP_H",
]

# Total types without an export: their rows are kept in the totals table only.
NOT_EXPORTED = ["PROTO_SERVICE_ORIG_H_P", "PROTO_SERVICE_RESP_H_P", "RESP_H"]

# Grouping columns besides the time bucket of the two detection feature tables.
DDOS_KEYS = ["ID_ORIG_H", "ID_RESP_H", "ID_RESP_P", "PROTO", "SERVICE"]
SCAN_KEYS = ["ID_ORIG_H", "ID_ORIG_P", "ID_RESP_H", "PROTO"]
