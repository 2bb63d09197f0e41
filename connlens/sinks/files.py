"""CSV and JSON exports, and the console preview."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Sensor times have microseconds.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header, replacing what is there. Read it with ``timestampFormat=TIMES``.

    A sorted frame gives files that are in order one after the other.
    """
    df.write.mode("overwrite").options(header=True, timestampFormat=TIMES).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write JSON lines, replacing what is there. Read them with ``timestampFormat=TIMES``."""
    df.write.mode("overwrite").option("timestampFormat", TIMES).json(path)


def preview(df: DataFrame, title: str, rows: int = 5) -> None:
    """Print the row count, the schema and the first rows."""
    print(f"{title}: {df.count()} rows")
    df.printSchema()
    df.show(rows)
