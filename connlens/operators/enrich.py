"""Enrichment of IP addresses from the table of known addresses."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookup_join, moment
from ..schemas import IP_INFO_SCHEMA

# One address in; a mapping with any of the IP_INFO columns out, or None.
Provider = Callable[[str], "dict[str, Any] | None"]

INFO_COLUMNS = [c for c in IP_INFO_SCHEMA.names if c not in ("IP", "TS_CODE")]


def _tells() -> Column:
    """Whether a row of IP_INFO tells anything of its address."""
    return F.coalesce(*[F.col(c).cast("string") for c in INFO_COLUMNS]).isNotNull()


def newest_info(info: DataFrame) -> DataFrame:
    """One row per address, the latest that tells anything; rows without an address are dropped.

    Keeps a left join from multiplying rows. Each map task passes on one row
    per address only.
    """
    latest = Window.partitionBy("IP").orderBy(
        F.desc(_tells()), F.desc("TS_CODE"), *INFO_COLUMNS
    )
    return (
        info.where(F.col("IP").isNotNull())
        .withColumn("_place", F.row_number().over(latest))
        .where(F.col("_place") == 1)
        .drop("_place")
    )


def distinct_ips(data: DataFrame, field: str) -> DataFrame:
    """The distinct addresses in a column."""
    return data.select(field).where(F.col(field).isNotNull()).distinct()


def ipinfo_known(info: DataFrame, data: DataFrame, field: str) -> DataFrame:
    """What is known about the addresses in a column of the data."""
    asked = distinct_ips(data, field).withColumnRenamed(field, "IP")
    return newest_info(info.join(asked, "IP", "left_semi"))


def asked(
    info: DataFrame, field: str, retry_before: str | datetime | None = None
) -> DataFrame:
    """The distinct addresses that need no lookup, as column ``field``.

    Those known, and those a lookup has told nothing about; the latter are to
    be asked again if the last lookup was before ``retry_before``.
    """
    if retry_before is not None:
        info = info.where(_tells() | (F.col("TS_CODE") >= moment(retry_before)))
    return info.select(F.col("IP").alias(field)).distinct()


def ipinfo_missing(
    info: DataFrame,
    data: DataFrame,
    field: str,
    retry_before: str | datetime | None = None,
) -> DataFrame:
    """The distinct addresses that have to be looked up, see :func:`asked`."""
    known = asked(info, field, retry_before)
    return distinct_ips(data, field).join(known, field, "left_anti")


def lookup_quota(
    info: DataFrame, today: str | datetime, per_day: int = 1000
) -> DataFrame:
    """How many lookups are left of the day's allowance, as one row."""
    used = info.where(F.col("TS_CODE") > moment(today))
    left = F.lit(per_day).cast("bigint") - F.count(F.lit(1))
    return used.agg(F.greatest(F.lit(0).cast("bigint"), left).alias("QUOTA"))


def lookup_candidates(
    info: DataFrame,
    data: DataFrame,
    field: str,
    limit: int,
    retry_before: str | datetime | None = None,
) -> DataFrame:
    """The busiest addresses to be looked up, at most ``limit`` of them, see :func:`asked`.

    Busy means the sum of COUNT, or the number of rows where there is none.
    """
    weight = F.sum("COUNT") if "COUNT" in data.columns else F.count(F.lit(1))
    known = asked(info, field, retry_before)
    return (
        data.where(F.col(field).isNotNull())
        .groupBy(field)
        .agg(weight.alias("COUNT"))
        .join(known, field, "left_anti")
        .orderBy(F.desc("COUNT"), field)
        .limit(limit)
    )


def look_up(
    candidates: DataFrame,
    field: str,
    provider: Provider,
    run_ts: str | datetime,
    tasks: int = 8,
) -> DataFrame:
    """Ask a provider about each address, in the shape of the IP_INFO table.

    The provider is called in the executors, over ``tasks`` tasks, once per
    address and attempt: write the result once and read it back rather than
    computing it twice. Its code must be importable there, or be defined inside
    a function or script, which sends it along. An address it fails on or knows nothing about
    gives a row without information, which counts as a lookup. Coordinates may come as text; what is not a number becomes null.
    """
    texts = ["IP", *INFO_COLUMNS]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for ip in batch[field]:
                try:
                    answer = provider(ip) or {}
                except Exception:  # one failed lookup must not end the job
                    logging.getLogger(__name__).warning("lookup failed: %s", ip)
                    answer = {}
                answer = {k.upper(): v for k, v in answer.items()} | {"IP": ip}
                values = [answer.get(c) for c in texts]
                found.append([None if v is None else str(v) for v in values])
            yield pd.DataFrame(found, columns=texts, dtype=object)

    answers = (
        candidates.select(field)
        .repartition(tasks)
        .mapInPandas(ask, ", ".join(f"{c} string" for c in texts))
        .withColumn("TS_CODE", moment(run_ts))
    )
    return answers.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in IP_INFO_SCHEMA]
    )


def ipinfo_union(known: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Known and newly looked-up rows, matched by column name."""
    return known.unionByName(looked_up, allowMissingColumns=True)


def enrich(data: DataFrame, info: DataFrame, field: str, **join: int) -> DataFrame:
    """Data rows with what is known about the address in a column.

    Every data row is kept once. ``join`` goes to :func:`lookup_join`.
    """
    columns = newest_info(info).drop("TS_CODE").withColumnRenamed("IP", field)
    return lookup_join(data, columns, [field], "left", **join)
