"""The network log as derived from the given tables, by SQL.

The text runs unchanged on Spark and on DuckDB, so a query and its check see
the same rows. FIXTURES.md describes the content. ``{...}`` names the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import CONN_SCHEMA, DNS_SCHEMA, HTTP_SCHEMA, RAW_SCHEMA

_BASE = """
SELECT event_id, user_id, event_type, value,
       CAST(FLOOR(event_id / 300) AS BIGINT) % 7 AS blk,
       TIMESTAMP '2024-01-01 00:00:00'
         + (INTERVAL '1' SECOND) * CAST(event_id * 2 AS BIGINT) AS ts0
FROM {events}
"""

# The same events over 30 days. Most are taken in within a minute, some more than a day later.
_BASE_30 = """
SELECT *, ts0 + (INTERVAL '1' MINUTE) * CASE WHEN event_id % 97 = 0 THEN 1600 ELSE 1 END AS taken
FROM (
  SELECT event_id, user_id, event_type, value,
         CAST(FLOOR(event_id / 300) AS BIGINT) % 7 AS blk,
         TIMESTAMP '2024-01-01 00:00:00' + (INTERVAL '1' DAY) * CAST(event_id % 30 AS BIGINT)
           + (INTERVAL '1' SECOND) * CAST(CAST(FLOOR(event_id / 30) AS BIGINT) * 53 % 86400 AS BIGINT) AS ts0
  FROM {events}) e
"""

# Hosts of the short log are few; those of the long one grow with the users.
_HOST = "concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(user_id % 20 AS STRING))"
_HOST_30 = """concat('10.', CAST(CAST(FLOOR(user_id / 65536) AS BIGINT) % 200 AS STRING), '.',
  CAST(CAST(FLOOR(user_id / 256) AS BIGINT) % 256 AS STRING), '.', CAST(user_id % 256 AS STRING))"""


def _common(taken: str, host: str) -> str:
    return f"""
  {taken} AS TS_CODE, ts0 AS TS, concat('C', CAST(event_id AS STRING)) AS UID,
  CASE WHEN blk = 3 THEN '10.9.9.9' ELSE {host} END AS ID_ORIG_H,
  CASE WHEN blk = 3 THEN 40000 ELSE 40000 + CAST(event_id % 50 AS INT) END AS ID_ORIG_P,
  CASE WHEN blk = 3 THEN '200.18.0.80'
       ELSE concat(CASE WHEN user_id % 2 = 0 THEN '200.18.' ELSE '198.51.' END,
                   CAST(user_id % 4 AS STRING), '.', CAST(event_id % 12 AS STRING))
  END AS ID_RESP_H,
  CASE WHEN blk = 3 THEN 80 WHEN event_type = 'click' THEN 80
       WHEN event_type = 'view' THEN 443 WHEN event_type = 'purchase' THEN 22
       WHEN event_type = 'signup' THEN 53 ELSE 0 END AS ID_RESP_P,
  CASE WHEN blk <> 3 AND event_type = 'signup' THEN 'udp'
       WHEN blk <> 3 AND event_type = 'error' THEN 'icmp' ELSE 'tcp' END AS PROTO
"""


_COMMON = _common("ts0", _HOST)


def _conn(common: str, base: str) -> str:
    return f"""
SELECT 'CONN' AS TIPO, {common},
  CASE WHEN blk = 3 OR event_type = 'click' THEN 'http' WHEN event_type = 'view' THEN 'ssl'
       WHEN event_type = 'purchase' THEN 'ssh' WHEN event_type = 'signup' THEN 'dns'
  END AS SERVICE,
  CASE WHEN event_type = 'error' THEN NULL
       ELSE CAST(event_id % 1000 AS DOUBLE) / 8 END AS DURATION,
  CASE WHEN event_type = 'error' THEN NULL
       ELSE CAST(FLOOR(value * 100 + 0.5) AS BIGINT) END AS ORIG_BYTES,
  CASE WHEN event_type = 'error' THEN NULL
       ELSE CAST(FLOOR(value * 300 + 0.5) AS BIGINT) END AS RESP_BYTES,
  CASE WHEN event_type = 'error' THEN 'REJ' WHEN event_id % 10 = 0 THEN 'S0'
       ELSE 'SF' END AS CONN_STATE,
  TRUE AS LOCAL_ORIG, user_id % 2 = 0 AS LOCAL_RESP,
  CAST(event_id % 4 AS BIGINT) AS MISSED_BYTES,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 10 = 0 THEN 'S'
       ELSE 'ShADadFf' END AS HISTORY,
  CAST(1 + event_id % 9 AS BIGINT) AS ORIG_PKTS,
  CAST(FLOOR(value * 100 + 0.5) AS BIGINT) + 40 AS ORIG_IP_BYTES,
  CAST(1 + event_id % 5 AS BIGINT) AS RESP_PKTS,
  CAST(FLOOR(value * 300 + 0.5) AS BIGINT) + 40 AS RESP_IP_BYTES
FROM ({base}) b
"""


CONN_SQL = _conn(_COMMON, _BASE)
ARRIVALS_SQL = _conn(_common("taken", _HOST_30), _BASE_30)

DNS_SQL = f"""
SELECT 'DNS' AS TIPO, {_COMMON},
  CAST(event_id % 65536 AS INT) AS TRANS_ID,
  concat(CASE WHEN user_id % 3 = 0 THEN 'www.' ELSE 'api.' END, 'site',
         CAST(user_id % 10 AS STRING), '.example.org') AS QUERY,
  1 AS QCLASS, 'C_INTERNET' AS QCLASS_NAME, 1 AS QTYPE, 'A' AS QTYPE_NAME,
  CASE WHEN user_id % 7 = 0 THEN 3 ELSE 0 END AS RCODE,
  CASE WHEN user_id % 7 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS RCODE_NAME,
  event_id % 2 = 0 AS AA, FALSE AS TC, TRUE AS RD, event_id % 3 = 0 AS RA, 0 AS Z,
  user_id % 7 = 0 AS REJECTED
FROM ({_BASE}) b WHERE event_type = 'signup'
"""

HTTP_SQL = f"""
SELECT 'HTTP' AS TIPO, {_COMMON},
  1 AS TRANS_DEPTH, '1.1' AS VERSION,
  CAST(event_id % 100 AS BIGINT) AS REQUEST_BODY_LEN,
  CAST(FLOOR(value * 300 + 0.5) AS BIGINT) AS RESPONSE_BODY_LEN,
  CASE WHEN user_id % 5 = 0 THEN 404 ELSE 200 END AS STATUS_CODE,
  CASE WHEN user_id % 5 = 0 THEN 'Not Found' ELSE 'OK' END AS STATUS_MSG
FROM ({_BASE}) b WHERE event_type = 'click'
"""

# Addresses of some log hosts, and one address per customer that the log does
# not use, so that the table grows with the data.
IP_INFO_SQL = """
SELECT IP, concat('h', CAST(n_nationkey AS STRING), '.example.org') AS HOSTNAME,
  concat('CITY', CAST(n_nationkey AS STRING)) AS CITY, r_name AS REGION,
  n_name AS COUNTRY, concat('ORG', CAST(n_regionkey AS STRING)) AS ORG,
  CAST(n_nationkey AS DOUBLE) / 2 AS LATITUDE, CAST(n_nationkey AS DOUBLE) / 4 AS LONGITUDE,
  TIMESTAMP '2024-01-01 00:00:00' + (INTERVAL '1' MINUTE) * CAST(seq AS BIGINT) AS TS_CODE
FROM (
  SELECT concat('10.0.', CAST(n_nationkey % 3 AS STRING), '.',
                CAST(n_nationkey % 20 AS STRING)) AS IP,
         n_nationkey AS nk, 0 AS seq
  FROM {nation}
  UNION ALL
  SELECT concat(CASE WHEN n_nationkey % 2 = 0 THEN '200.18.' ELSE '198.51.' END,
                CAST(n_nationkey % 4 AS STRING), '.', CAST(n_nationkey AS STRING)) AS IP,
         n_nationkey AS nk, 0 AS seq
  FROM {nation} WHERE n_nationkey < 12
  UNION ALL
  SELECT concat('172.', CAST(16 + CAST(FLOOR(c_custkey / 65536) AS BIGINT) AS STRING), '.',
                CAST(CAST(FLOOR(c_custkey / 256) AS BIGINT) % 256 AS STRING), '.',
                CAST(c_custkey % 256 AS STRING)) AS IP,
         c_nationkey AS nk, c_custkey AS seq
  FROM {customer}
) a JOIN {nation} ON nk = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


# Given as a schema, so that no job has to look the columns up first.
_COLUMNS = {
    "events": "event_id bigint, user_id bigint, event_type string, value double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_nationkey int",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, events=_table(spark, sf_dir, "events"))


def conn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, CONN_SQL).select(*CONN_SCHEMA.names)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of 30 days, some of them taken in late."""
    return _log(spark, sf_dir, ARRIVALS_SQL).select(*CONN_SCHEMA.names)


def dns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, DNS_SQL).select(*DNS_SCHEMA.names)


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, HTTP_SQL).select(*HTTP_SCHEMA.names)


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide raw table; a filter on TIPO leaves one scan of it."""
    logs = [build(spark, sf_dir) for build in (conn_log, dns_log, http_log)]
    wide = [_widened(log) for log in logs]
    return wide[0].union(wide[1]).union(wide[2])


def _widened(log: DataFrame) -> DataFrame:
    have = set(log.columns)
    return log.selectExpr(
        *[
            f.name
            if f.name in have
            else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}"
            for f in RAW_SCHEMA
        ]
    )


def ip_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nation", "region", "customer")
    return spark.sql(IP_INFO_SQL, **{n: _table(spark, sf_dir, n) for n in names})
