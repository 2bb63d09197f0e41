"""Runs a query on Spark and its SQL on DuckDB, and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_result(df):
    return sorted(c.lower() for c in df.columns), rows_of(df.columns, df.collect())


def duck_result(con, sql: str):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(c.lower() for c in columns), rows_of(columns, result.fetchall())
