"""Reports on stored totals and scores, written as CSV."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import attackers
from ..operators.enrich import enrich
from ..operators.exports import busiest_first, totals_export, with_text_time
from ..operators.pivots import history, spread, victim_counts
from ..operators.ranking import (
    inbound_to_prefix,
    orig_h_ranking,
    resp_h_ranking,
    responder_totals,
)
from ..schemas import DEFAULT_TOTAL_TYPES
from ..session import configure
from ..sinks import write_csv, write_wide
from ..sources.tables import select_scores, select_totals
from .detection import DDOS_SERVICES, SCAN_PROTOS
from .enrichment import Lookups, look_up_missing

# Total type -> column of its pivots.
PIVOTS = {"PROTO": "PROTO", "PROTO_SERVICE": "SERVICE"}


def report_sources(
    totals: DataFrame,
    info: DataFrame,
    since: str | datetime,
    run_ts: datetime,
    out: str,
    prefix: str,
    lookups: Lookups | None = None,
) -> DataFrame:
    """Sources of connections into a network, with what is known about them.

    Writes the enriched totals and returns the enriched ranking. With ``lookups``,
    unknown addresses of the ranking are looked up first.
    """
    configure(totals.sparkSession)
    recent = select_totals(totals, since, "ORIG_H_RESP_H")
    ranking = orig_h_ranking(recent, prefix)
    info = look_up_missing(ranking, info, "ID_ORIG_H", run_ts, lookups)
    rows = enrich(inbound_to_prefix(recent, prefix), info, "ID_ORIG_H")
    write_csv(busiest_first(rows, "ORIG_H_RESP_H"), f"{out}/ORIG_H_RESP_H_INFO_WEB")
    return enrich(ranking, info, "ID_ORIG_H")


def report_responders(
    totals: DataFrame,
    info: DataFrame,
    since: str | datetime,
    run_ts: datetime,
    out: str,
    lookups: Lookups | None = None,
) -> DataFrame:
    """Targets of connections, with what is known about them.

    Writes the enriched totals and returns the enriched ranking.
    """
    configure(totals.sparkSession)
    recent = select_totals(totals, since, "PROTO_SERVICE_RESP_H")
    ranking = resp_h_ranking(recent)
    info = look_up_missing(ranking, info, "ID_RESP_H", run_ts, lookups)
    rows = enrich(responder_totals(recent), info, "ID_RESP_H")
    write_csv(busiest_first(rows, "PROTO_SERVICE_RESP_H"), f"{out}/PROTO_SERVICE_RESP_H_INFO_WEB")
    return enrich(ranking, info, "ID_RESP_H")


def report_totals(
    totals: DataFrame,
    since: str | datetime,
    out: str,
    tipos: Sequence[str] = DEFAULT_TOTAL_TYPES,
) -> None:
    """Write the sorted totals of each type, and the pivots by hour and day."""
    configure(totals.sparkSession)
    recent = select_totals(totals, since)
    for tipo in tipos:
        write_csv(totals_export(recent, tipo), f"{out}/{tipo}")
    for tipo, column in PIVOTS.items():
        if tipo in tipos:
            rows = recent.where(F.col("TIPO") == tipo)
            for grain, name in (("hour", "H"), ("day", "D")):
                target = f"{out}/{tipo}_{tipo}_PIVOT_{name}"
                write_history(history(rows, column, grain), column, target, grain, wide=True)


def report_hosts(
    totals: DataFrame,
    since: str | datetime,
    out: str,
    services: Sequence[str] = DDOS_SERVICES,
) -> None:
    """Write the hourly connections of each service with a column per source, however many there are.

    Each is a set of files of bounded width, to be read by :func:`connlens.sinks.read_wide`.
    """
    configure(totals.sparkSession)
    recent = select_totals(totals, since, "PROTO_SERVICE_ORIG_H")
    for service in services:
        rows = recent.where(F.col("SERVICE") == service)
        long = history(rows, "ID_ORIG_H", "hour")
        write_wide(long, "ID_ORIG_H", f"{out}/PROTO_SERVICE_ORIG_H_{service}_PIVOT_H")


def write_history(
    long: DataFrame, column: str, path: str, grain: str, wide: bool
) -> None:
    """Write a history as CSV, in the layout the caller chooses.

    Wide: one column per value, for columns of a few values such as protocols. Long: time, value
    and COUNT, sorted, for hosts, of which there may be any number.
    """
    if not wide:
        write_csv(with_text_time(long.orderBy("TS", column), grain), path)
        return
    long = long.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_csv(with_text_time(spread(long, column), grain), path)
    finally:
        long.unpersist()


def _attack_rows(
    scores: DataFrame, since: str | datetime, kind_column: str, kinds: Sequence[str]
) -> DataFrame:
    rows = select_scores(scores, since).where(F.col(kind_column).isin(*kinds))
    return rows.where(F.col("PREDICTION") == 1)


def report_scores(
    scores: DataFrame,
    info: DataFrame,
    since: str | datetime,
    run_ts: datetime,
    out: str,
    kind_column: str,
    kinds: Sequence[str],
    label: str,
    native: str,
    lookups: Lookups | None = None,
    wide: bool = False,
) -> dict[str, DataFrame]:
    """Write the enriched scores and the victims' histories of each kind.

    ``native`` is the time bucket of the scored rows. With ``wide`` the histories have a column per victim, in
    sets of files of bounded width (see :func:`connlens.sinks.write_wide`), and long rows otherwise. Returns the enriched
    attackers by kind. Attackers of all kinds are looked up in one step.
    """
    attack = _attack_rows(scores, since, kind_column, kinds)
    info = look_up_missing(attack, info, "ID_ORIG_H", run_ts, lookups)
    found = {}
    for kind in kinds:
        rows = select_scores(scores, since).where(F.col(kind_column) == kind)
        hosts = attackers(rows, kind_column).select("ID_ORIG_H")
        found[kind] = enrich(hosts, info, "ID_ORIG_H")
        enriched = enrich(rows.drop("CENTROID"), info, "ID_ORIG_H")
        write_csv(enriched, f"{out}/{label}_{kind}")
        # The first file is at the rows' own time, whatever its name says.
        for grain, name in ((native, "M"), ("hour", "H")):
            long = victim_counts(rows, kind_column, grain)
            target = f"{out}/{label}_{kind}_PIVOT_{name}"
            if wide:
                write_wide(long, "ID_RESP_H", target)
            else:
                write_history(long, "ID_RESP_H", target, grain, wide=False)
    return found


def report_ddos(
    scores: DataFrame,
    info: DataFrame,
    since: str | datetime,
    run_ts: datetime,
    out: str,
    services: Sequence[str] = DDOS_SERVICES,
    lookups: Lookups | None = None,
) -> dict[str, DataFrame]:
    """Report on scored DDoS rows, see :func:`report_scores`."""
    return report_scores(
        scores, info, since, run_ts, out, "SERVICE", services, "DDoS", "minute", lookups
    )


def report_scan(
    scores: DataFrame,
    info: DataFrame,
    since: str | datetime,
    run_ts: datetime,
    out: str,
    protos: Sequence[str] = SCAN_PROTOS,
    lookups: Lookups | None = None,
) -> dict[str, DataFrame]:
    """Report on scored port-scan rows, see :func:`report_scores`."""
    return report_scores(
        scores, info, since, run_ts, out, "PROTO", protos, "Scan", "hour", lookups
    )


def report_all(
    totals: DataFrame,
    ddos_scores: DataFrame,
    scan_scores: DataFrame,
    info: DataFrame,
    since: str | datetime,
    run_ts: datetime,
    out: str,
    lookups: Lookups | None = None,
) -> None:
    """The whole report: responders, totals, DDoS and port scans.

    Responders and attackers are looked up together, in one step, before any file is written.
    """
    ddos = _attack_rows(ddos_scores, since, "SERVICE", DDOS_SERVICES)
    scan = _attack_rows(scan_scores, since, "PROTO", SCAN_PROTOS)
    responders = select_totals(totals, since, "PROTO_SERVICE_RESP_H")
    hosts = responders.select(F.col("ID_RESP_H").alias("IP"), "COUNT")
    for rows in (ddos, scan):
        hosts = hosts.union(rows.select(F.col("ID_ORIG_H").alias("IP"), "COUNT"))
    info = look_up_missing(hosts, info, "IP", run_ts, lookups)
    report_responders(totals, info, since, run_ts, out)
    report_totals(totals, since, out)
    report_ddos(ddos_scores, info, since, run_ts, out)
    report_scan(scan_scores, info, since, run_ts, out)
