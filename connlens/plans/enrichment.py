"""Enrichment with lookups of the addresses still unknown."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import (
    Provider,
    enrich,
    ipinfo_union,
    look_up,
    lookup_candidates,
    lookup_quota,
)
from ..session import materialize
from ..sinks import append_ip_info
from ..sinks.ledger import Reservation, journal_of, journaled, reserve, reserved, settle, unsettled


@dataclass(frozen=True)
class Lookups:
    """How a job looks up addresses.

    provider: is asked about one address, see :func:`look_up`.
    store: the folder of the IP_INFO table, to which all answers are added.
    limit: most lookups of one job, the busiest addresses first.
    per_day: the allowance of a day, over all jobs with the same IP_INFO.
    retry_before: addresses without an answer are asked again if that was
        before this time; None asks each address once.
    tasks: how many tasks ask at the same time.
    ledger: the folder of a ledger of lookups. With it the allowance holds for jobs that run side by side too, it is counted
        by reservations alone, and a job that runs again asks nothing twice. Needs a store.
    job: the job's name in the ledger, one for each job that runs at a time; the time of the run if None.
    tries, wait, per_second: see :func:`journaled`; every try counts towards the allowance. With a ledger only.
    """

    provider: Provider
    store: str | None = None
    limit: int = 1000
    per_day: int = 1000
    retry_before: datetime | None = None
    tasks: int = 8
    ledger: str | None = None
    job: str | None = None
    tries: int = 1
    wait: float = 1.0
    per_second: float | None = None


# Later than any retry: an address that is reserved needs no lookup.
_RESERVED_AT = datetime(9999, 1, 1)


def _look_up_reserved(
    hosts: DataFrame, info: DataFrame, field: str, run_ts: datetime, lookups: Lookups
) -> None:
    """Ask what the ledger grants, after what an earlier attempt of the job has left open, and store the answers.

    An attempt lost between storing and settling stores its answers twice; readers take one.
    """
    ledger, spark, day = lookups.ledger, info.sparkSession, run_ts.date()
    job = lookups.job or run_ts.isoformat()
    provider = journaled(
        lookups.provider, journal_of(ledger, day), lookups.tries, lookups.wait, lookups.per_second
    )

    def ask(granted: Reservation) -> None:
        addresses = reserved(spark, [granted])
        found = materialize(look_up(addresses, "IP", provider, run_ts, lookups.tasks))
        append_ip_info(found, lookups.store)
        settle(spark, ledger, day, granted)

    def choose(taken: DataFrame, most: int) -> DataFrame:
        stored = spark.read.schema(info.schema).parquet(lookups.store)
        known = ipinfo_union(stored, taken.withColumn("TS_CODE", F.lit(_RESERVED_AT)))
        wanted = lookup_candidates(known, hosts, field, min(most, lookups.limit), lookups.retry_before)
        return wanted.select(F.col(field).alias("IP"))

    for left in unsettled(spark, ledger, day, job):
        ask(left)
    granted = reserve(spark, ledger, day, job, choose, lookups.per_day, lookups.tries)
    if granted is not None:
        ask(granted)


def look_up_missing(
    hosts: DataFrame,
    info: DataFrame,
    field: str,
    run_ts: datetime,
    lookups: Lookups | None,
) -> DataFrame:
    """IP_INFO with the addresses in ``field`` that were looked up now.

    With a store, IP_INFO is read from it again, so that what earlier calls have added counts
    towards the allowance and is not asked for again. Lookups are written once and
    read back, so none is repeated.
    """
    if lookups is None:
        return info
    store, spark = lookups.store, info.sparkSession
    if lookups.ledger is not None:
        if store is None:
            raise ValueError("a ledger needs the store that answers go to")
        _look_up_reserved(hosts, info, field, run_ts, lookups)
        return spark.read.schema(info.schema).parquet(store)
    if store is not None:
        info = spark.read.schema(info.schema).parquet(store)
    today = run_ts.replace(hour=0, minute=0, second=0, microsecond=0)
    quota = lookup_quota(info, today, lookups.per_day).first()["QUOTA"]
    most = min(lookups.limit, quota)
    if most <= 0:
        return info
    wanted = lookup_candidates(info, hosts, field, most, lookups.retry_before)
    found = materialize(look_up(wanted, field, lookups.provider, run_ts, lookups.tasks))
    if store is None:
        return ipinfo_union(info, found)
    append_ip_info(found, store)
    return spark.read.schema(info.schema).parquet(store)


def process_ips(
    data: DataFrame,
    info: DataFrame,
    field: str,
    run_ts: datetime,
    lookups: Lookups | None = None,
) -> DataFrame:
    """Data rows with the IP_INFO columns of the address in ``field``.

    With ``lookups``, unknown addresses are looked up first.
    """
    return enrich(data, look_up_missing(data, info, field, run_ts, lookups), field)
