"""One query per operator, each over the whole log derived from the tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import clusters, dns, enrich, exports, features, lloyd, pivots, ranking
from ..operators.lattice import totals_by_lattice
from ..operators.totals import roll_up, tag_run, totals, totals_all
from ..plans.detection import DDOS_SERVICES, SCAN_PROTOS, run_ddos, run_scan
from ..plans.enrichment import Lookups
from ..plans.report import report_sources
from ..plans.totals import add_totals, run_totals
from ..schemas import (
    CONN_SCHEMA,
    DDOS_KEYS,
    DNS_SCHEMA,
    GROUP_COLUMNS,
    MEASURES,
    SCAN_KEYS,
    TOTAL_TYPES,
)
from ..session import configure, materialize, scratch_folder
from ..sinks import (
    compact_results,
    load_model,
    read_results,
    read_wide,
    save_model,
    vacuum_results,
    write_csv,
    write_json,
    write_results,
    write_wide,
)
from ..sources import records, store, tables

Query = Callable[[SparkSession, str], DataFrame]

PREFIX = "200.18."
SINCE = "2024-01-01 02:00:00"
WITHIN = "2024-01-01 02:30:30"  # in the middle of an hour and of a minute
EARLY_RUN = datetime(2024, 2, 1)
BETWEEN_RUNS = "2024-02-15 00:00:00"
LATE_RUN = datetime(2024, 3, 1)
TODAY = "2024-01-02 00:00:00"
LOOKUPS = 20
FIRST_RUN = datetime(2024, 1, 20, 12)
AFTER = "2024-01-21 07:30:00"  # within the 30 days
ROLLED_UP = ["PROTO", "PROTO_SERVICE", "PROTO_SERVICE_RESP_H"]

_QUERIES: dict[str, Query] = {}


def query(name: str, *args) -> Callable:
    """Register a query under a name; further arguments go to the function."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir, *args)

        _QUERIES[name] = run
        return build

    return add


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Row selections and extracts


@query("select_recent")
def _select_recent(spark, sf):
    rows = tables.select_recent(fx.raw_log(spark, sf), SINCE)
    return rows.select("TIPO", *CONN_SCHEMA.names[1:], *DNS_SCHEMA.names[9:])


@query("select_conn")
def _select_conn(spark, sf):
    rows = tables.select_conn(fx.raw_log(spark, sf), SINCE)
    return rows.select(*CONN_SCHEMA.names)


def _two_runs(rows_of, spark, sf):
    """Results of the whole log by an early run and of its end by a late run."""
    raw = fx.raw_log(spark, sf)
    early = rows_of(tables.select_conn(raw))
    late = rows_of(tables.select_conn(raw, SINCE))
    return tag_run(early, SINCE, EARLY_RUN).unionByName(tag_run(late, SINCE, LATE_RUN))


@query("select_results")
def _select_results(spark, sf):
    raw = fx.raw_log(spark, sf)
    mixed = raw.unionByName(
        _two_runs(lambda conn: totals(conn, "PROTO"), spark, sf),
        allowMissingColumns=True,
    )
    rows = tables.select_results(mixed, SINCE, "CONN")
    return rows.select(*CONN_SCHEMA.names)


@query("select_totals")
def _select_totals(spark, sf):
    runs = _two_runs(totals_all, spark, sf)
    rows = tables.select_totals(runs, BETWEEN_RUNS, "ORIG_H_RESP_H")
    return rows.select("TIPO", "TS", "ID_ORIG_H", "ID_RESP_H", "COUNT", "TS_CODE")


@query("select_scores")
def _select_scores(spark, sf):
    runs = _two_runs(
        lambda conn: features.ddos_features(conn, DDOS_SERVICES), spark, sf
    )
    return tables.select_scores(runs, BETWEEN_RUNS).drop("TS_FILTRO")


@query("conn_records")
def _conn_records(spark, sf):
    return records.conn_records(fx.raw_log(spark, sf))


@query("dns_records")
def _dns_records(spark, sf):
    return records.dns_records(fx.raw_log(spark, sf))


@query("http_records")
def _http_records(spark, sf):
    return records.http_records(fx.raw_log(spark, sf))


# DNS


def _lookups(spark, sf):
    return dns.dns_www(records.dns_records(fx.raw_log(spark, sf)))


def _conn_www(spark, sf):
    conn = records.conn_records(fx.raw_log(spark, sf))
    return dns.conn_by_dns_query(conn, _lookups(spark, sf))


@query("dns_www")
def _dns_www(spark, sf):
    return _lookups(spark, sf)


@query("conn_by_dns_query")
def _conn_by_dns_query(spark, sf):
    return dns.by_orig_bytes(_conn_www(spark, sf))


@query("conn_www_sum")
def _conn_www_sum(spark, sf):
    return dns.conn_www_sum(_conn_www(spark, sf))


# Totals


_conn = fx.conn_log


for _tipo in TOTAL_TYPES:

    @query(f"totals_{_tipo.lower()}", _tipo)
    def _totals(spark, sf, tipo):
        return totals(_conn(spark, sf), tipo)


for _tipo in exports.EXPORTED:

    @query(f"export_totals_{_tipo.lower()}", _tipo)
    def _export_totals(spark, sf, tipo):
        return exports.totals_export(totals(_conn(spark, sf), tipo), tipo)


@query("totals_all")
def _totals_all(spark, sf):
    return totals_all(_conn(spark, sf))


@query("totals_all_23")
def _totals_all_23(spark, sf):
    return totals_by_lattice(_conn(spark, sf), list(TOTAL_TYPES))


@query("totals_rolled_up")
def _totals_rolled_up(spark, sf):
    fine = totals_all(_conn(spark, sf), ["PROTO_SERVICE_RESP_H_P"])
    return roll_up(fine, ROLLED_UP)


@query("totals_stored")
def _totals_stored(spark, sf):
    """The totals jobs: fine types from the log, the rest from their stored rows."""
    table, finest = scratch_folder(spark), "PROTO_SERVICE_RESP_H_P"
    run_totals(fx.raw_log(spark, sf), SINCE, LATE_RUN, table, [finest, "ORIG_H_RESP_H"])
    add_totals(spark, SINCE, LATE_RUN, table, finest, ROLLED_UP)
    stored = read_results(spark, table, run_ts=LATE_RUN)
    return stored.drop("TS_FILTRO", "TS_CODE", "ROW_ID")


@query("results_upsert")
def _results_upsert(spark, sf):
    """A late run over the end of the log replaces the keys of an early one."""
    raw, table = fx.raw_log(spark, sf), scratch_folder(spark)
    for since, run_ts in ((None, EARLY_RUN), (SINCE, LATE_RUN), (SINCE, LATE_RUN)):
        rows = totals(tables.select_conn(raw, since, "hour"), "PROTO_SERVICE")
        write_results(tag_run(rows, since, run_ts), table, run_ts, by=["TIPO"])
    newest = read_results(spark, table, ["TIPO", "TS", "PROTO", "SERVICE"])
    return newest.drop("TS_FILTRO", "ROW_ID")


@query("results_compacted")
def _results_compacted(spark, sf):
    """The same, merged into a base before the late run and after it; the merged runs are removed."""
    raw, table = fx.raw_log(spark, sf), scratch_folder(spark)
    keys = ["TIPO", "TS", "PROTO", "SERVICE"]
    for since, run_ts in ((None, EARLY_RUN), (SINCE, LATE_RUN)):
        rows = totals(tables.select_conn(raw, since, "hour"), "PROTO_SERVICE")
        write_results(tag_run(rows, since, run_ts), table, run_ts, by=["TIPO"])
        compact_results(spark, table, keys, by=["TIPO"])
        vacuum_results(spark, table)
    return read_results(spark, table, keys).drop("TS_FILTRO", "ROW_ID")


@query("results_base_and_run")
def _results_base_and_run(spark, sf):
    """The same, read from a base of the early run and the late run beside it."""
    raw, table = fx.raw_log(spark, sf), scratch_folder(spark)
    keys = ["TIPO", "TS", "PROTO", "SERVICE"]
    for since, run_ts in ((None, EARLY_RUN), (SINCE, LATE_RUN)):
        rows = totals(tables.select_conn(raw, since, "hour"), "PROTO_SERVICE")
        write_results(tag_run(rows, since, run_ts), table, run_ts, by=["TIPO"])
        if since is None:
            compact_results(spark, table, keys, by=["TIPO"])
    return read_results(spark, table, keys).drop("TS_FILTRO", "ROW_ID")


@query("totals_two_runs")
def _totals_two_runs(spark, sf):
    """A second run from within an hour leaves the totals of the whole log."""
    raw, table = fx.raw_log(spark, sf), scratch_folder(spark)
    run_totals(raw, None, EARLY_RUN, table)
    run_totals(raw, WITHIN, LATE_RUN, table)
    newest = read_results(spark, table, ["TIPO", "TS", *GROUP_COLUMNS])
    return newest.drop("TS_FILTRO", "TS_CODE", "ROW_ID")


for _attack, _job, _keys in (("ddos", run_ddos, DDOS_KEYS), ("scan", run_scan, SCAN_KEYS)):

    @query(f"scores_two_runs_{_attack}", _job, _keys)
    def _scores_two_runs(spark, sf, job, keys):
        """A second run from within a bucket leaves the counts of the whole log."""
        raw, table, models = fx.raw_log(spark, sf), scratch_folder(spark), scratch_folder(spark)
        for since, run_ts in ((None, EARLY_RUN), (WITHIN, LATE_RUN)):
            job(raw, since, run_ts, table, models)
        newest = read_results(spark, table, [*keys, "TS"])
        return newest.select(*keys, "TS", "COUNT", *MEASURES)

    @query(f"detection_fit_{_attack}", _job)
    def _detection_fit(spark, sf, job):
        """What the job reports of its fit: all kinds, with centres, rows and errors."""
        table, models = scratch_folder(spark), scratch_folder(spark)
        fit = job(fx.raw_log(spark, sf), None, EARLY_RUN, table, models)
        return fit.withColumns({c: F.round(c, 6) for c in ("CENTRE", "WSSSE")})


# The log by days, and records that arrive late


def _stored_log(spark, sf):
    path = scratch_folder(spark)
    store.ingest(fx.arrivals(spark, sf), path)
    return store.read_log(spark, path)


@query("select_conn_by_day")
def _select_conn_by_day(spark, sf):
    return tables.select_conn(_stored_log(spark, sf), AFTER).select(*CONN_SCHEMA.names)


@query("select_recent_by_day")
def _select_recent_by_day(spark, sf):
    return tables.select_recent(_stored_log(spark, sf), AFTER).select(*CONN_SCHEMA.names)


def _arrived(raw):
    """What a first run has seen."""
    return store.in_time(raw, "TS_CODE", until=FIRST_RUN)


@query("totals_late_records")
def _totals_late_records(spark, sf):
    """A second run counts the hours anew that records taken in after the first belong to."""
    raw, table = _stored_log(spark, sf), scratch_folder(spark)
    run_totals(_arrived(raw), None, FIRST_RUN, table)
    run_totals(raw, FIRST_RUN, LATE_RUN, table, arrived=True)
    newest = read_results(spark, table, ["TIPO", "TS", *GROUP_COLUMNS])
    return newest.drop("TS_FILTRO", "TS_CODE", "ROW_ID")


for _attack, _job, _keys in (("ddos", run_ddos, DDOS_KEYS), ("scan", run_scan, SCAN_KEYS)):

    @query(f"scores_late_records_{_attack}", _job, _keys)
    def _scores_late_records(spark, sf, job, keys):
        """The counts of the whole log, after a run before and one after late records."""
        raw, table, models = _stored_log(spark, sf), scratch_folder(spark), scratch_folder(spark)
        job(_arrived(raw), None, FIRST_RUN, table, models)
        job(raw, FIRST_RUN, LATE_RUN, table, models, arrived=True)
        newest = read_results(spark, table, [*keys, "TS"])
        return newest.select(*keys, "TS", "COUNT", *MEASURES)


for _column, _tipo in (("PROTO", "PROTO"), ("SERVICE", "PROTO_SERVICE")):

    @query(f"pivot_{_column.lower()}_30_days", _column, _tipo)
    def _pivot_30_days(spark, sf, column, tipo):
        return pivots.pivot(totals(fx.arrivals(spark, sf), tipo), column, "day")


# Rankings


@query("top_conn_by_bytes")
def _top_conn_by_bytes(spark, sf):
    top = ranking.top_conn_by_bytes(records.conn_records(fx.raw_log(spark, sf)))
    return top.select("UID", "TS", "ID_ORIG_H", "ID_RESP_H", "ORIG_BYTES")


@query("inbound_to_prefix")
def _inbound_to_prefix(spark, sf):
    pairs = totals(_conn(spark, sf), "ORIG_H_RESP_H")
    return ranking.inbound_to_prefix(pairs, PREFIX)


@query("orig_h_ranking")
def _orig_h_ranking(spark, sf):
    return ranking.orig_h_ranking(totals(_conn(spark, sf), "ORIG_H_RESP_H"), PREFIX)


@query("resp_h_ranking")
def _resp_h_ranking(spark, sf):
    return ranking.resp_h_ranking(totals(_conn(spark, sf), "PROTO_SERVICE_RESP_H"))


# Enrichment


@query("distinct_ips")
def _distinct_ips(spark, sf):
    return enrich.distinct_ips(_conn(spark, sf), "ID_RESP_H")


@query("ipinfo_known")
def _ipinfo_known(spark, sf):
    return enrich.ipinfo_known(fx.ip_info(spark, sf), _conn(spark, sf), "ID_ORIG_H")


@query("ipinfo_missing")
def _ipinfo_missing(spark, sf):
    return enrich.ipinfo_missing(fx.ip_info(spark, sf), _conn(spark, sf), "ID_ORIG_H")


@query("lookup_quota")
def _lookup_quota(spark, sf):
    return enrich.lookup_quota(fx.ip_info(spark, sf), TODAY)


def _candidates(spark, sf):
    rows = totals(_conn(spark, sf), "ORIG_H_RESP_H")
    return enrich.lookup_candidates(
        fx.ip_info(spark, sf), rows, "ID_ORIG_H", LOOKUPS
    )


@query("lookup_candidates")
def _lookup_candidates(spark, sf):
    return _candidates(spark, sf)


def _sample_provider() -> enrich.Provider:
    """Stands for a caller's lookup: knows all but the 10.0.2 network."""

    # Defined in here, so that it travels to the executors with its code.
    def ask(ip: str) -> dict | None:
        if ip.startswith("10.0.2."):
            return None
        last = int(ip.rsplit(".", 1)[1])
        city = "unknown" if last % 2 else None
        return {"hostname": f"host-{ip}", "city": city, "latitude": f"{last}.5"}

    return ask


@query("ipinfo_union")
def _ipinfo_union(spark, sf):
    info, conn = fx.ip_info(spark, sf), _conn(spark, sf)
    found = enrich.look_up(
        _candidates(spark, sf), "ID_ORIG_H", _sample_provider(), LATE_RUN
    )
    return enrich.ipinfo_union(enrich.ipinfo_known(info, conn, "ID_ORIG_H"), found)


@query("report_sources_file")
def _report_sources_file(spark, sf):
    """The report on sources with lookups, run as a job, and its file read back."""
    table, store, out = (scratch_folder(spark) for _ in range(3))
    run_totals(fx.raw_log(spark, sf), None, EARLY_RUN, table, ["ORIG_H_RESP_H"])
    fx.ip_info(spark, sf).write.parquet(store)
    stored, info = read_results(spark, table, run_ts=EARLY_RUN), spark.read.parquet(store)
    lookups = Lookups(_sample_provider(), store)
    report_sources(stored, info, TODAY, LATE_RUN, out, PREFIX, lookups)
    file = spark.read.csv(f"{out}/ORIG_H_RESP_H_INFO_WEB", header=True)
    numbers = {"TS": "timestamp", "COUNT": "bigint", "LATITUDE": "double"}
    typed = file.withColumns({c: F.col(c).cast(t) for c, t in numbers.items()})
    return typed.select("ID_ORIG_H", "ID_RESP_H", *numbers, "HOSTNAME", "CITY", "COUNTRY")


@query("enrich_resp_h")
def _enrich_resp_h(spark, sf):
    rows = ranking.responder_totals(totals(_conn(spark, sf), "PROTO_SERVICE_RESP_H"))
    known = enrich.enrich(rows, fx.ip_info(spark, sf), "ID_RESP_H")
    return exports.busiest_first(known, "PROTO_SERVICE_RESP_H")


@query("enrich_orig_h")
def _enrich_orig_h(spark, sf):
    rows = ranking.inbound_to_prefix(totals(_conn(spark, sf), "ORIG_H_RESP_H"), PREFIX)
    known = enrich.enrich(rows, fx.ip_info(spark, sf), "ID_ORIG_H")
    return exports.busiest_first(known, "ORIG_H_RESP_H")


@query("ranked_resp_h_enriched")
def _ranked_resp_h_enriched(spark, sf):
    return enrich.enrich(_resp_h_ranking(spark, sf), fx.ip_info(spark, sf), "ID_RESP_H")


@query("ranked_orig_h_enriched")
def _ranked_orig_h_enriched(spark, sf):
    return enrich.enrich(_orig_h_ranking(spark, sf), fx.ip_info(spark, sf), "ID_ORIG_H")


# Detection

_KIND = {"ddos": "SERVICE", "scan": "PROTO"}
_KINDS = {"ddos": DDOS_SERVICES, "scan": SCAN_PROTOS}
_FEATURES = {"ddos": features.ddos_features, "scan": features.scan_features}


@query("ddos_features")
def _ddos_features(spark, sf):
    return features.ddos_features(_conn(spark, sf), DDOS_SERVICES)


@query("scan_features")
def _scan_features(spark, sf):
    return features.scan_features(_conn(spark, sf), SCAN_PROTOS)


def _trained(spark, sf, attack, kinds):
    """Feature rows, written once, and the centres fitted on each kind."""
    rows = materialize(_FEATURES[attack](_conn(spark, sf), kinds))
    return rows, clusters.train_kinds(rows, _KIND[attack], kinds)


def _scored(spark, sf, attack, kinds):
    rows, centres = _trained(spark, sf, attack, kinds)
    return clusters.score_kinds(rows, _KIND[attack], centres)


for _attack, _kinds in _KINDS.items():
    for _kind in _kinds:

        @query(f"detect_{_attack}_{_kind}", _attack, _kind)
        def _detect(spark, sf, attack, kind):
            scored = _scored(spark, sf, attack, [kind]).drop("CENTROID")
            return scored.withColumn("CENTRE", F.round("CENTRE", 6))


@query("kmeans_train")
def _kmeans_train(spark, sf):
    """Fit, save, load again and report the centres with their rows."""
    rows = materialize(features.ddos_features(_conn(spark, sf), ["http"]))
    path = scratch_folder(spark)
    save_model(spark, clusters.train(rows), path)
    scored = clusters.score(rows, load_model(spark, path))
    sizes = clusters.centre_sizes(scored)
    return sizes.withColumn("CENTRE", F.round("CENTRE", 6))


@query("kmeans_centers")
def _kmeans_centers(spark, sf):
    sizes = clusters.centre_sizes(_scored(spark, sf, "scan", ["tcp"]))
    return sizes.withColumn("CENTRE", F.round("CENTRE", 6))


@query("kmeans_wssse")
def _kmeans_wssse(spark, sf):
    error = clusters.wssse(_scored(spark, sf, "ddos", ["http"]))
    return error.select(F.round("WSSSE", 6).alias("WSSSE"))


@query("kmeans_silhouette")
def _kmeans_silhouette(spark, sf):
    """Of all kinds, services and protocols."""
    parts = [
        clusters.silhouette(_scored(spark, sf, attack, kinds), _KIND[attack])
        for attack, kinds in _KINDS.items()
    ]
    return parts[0].union(parts[1]).withColumn("SILHOUETTE", F.round("SILHOUETTE", 6))


def _multi(spark, sf):
    """The points of three features and their clusters from the two extreme starts."""
    columns = ["DURATION", "ORIG_PKTS", "ORIG_BYTES"]
    rows = totals(_conn(spark, sf), "PROTO_SERVICE_ORIG_H")
    points = materialize(lloyd.usable(rows, columns))
    return points, lloyd.lloyd(points, columns, lloyd.extremes(points, columns))


@query("kmeans_multi")
def _kmeans_multi(spark, sf):
    return lloyd.score_points(*_multi(spark, sf))


@query("kmeans_multi_fit")
def _kmeans_multi_fit(spark, sf):
    """Centres, number of rows and squared errors."""
    fit = lloyd.fit_table(*_multi(spark, sf))
    shown = {"DURATION": 6, "ORIG_PKTS": 6, "ORIG_BYTES": 6, "WSSSE": 0}
    return fit.withColumns({c: F.round(c, digits) for c, digits in shown.items()})


for _attack, _kinds in _KINDS.items():
    _suffix = "" if _attack == "ddos" else f"_{_attack}"

    @query(f"attackers_{_attack}", _attack, _kinds)
    def _attackers(spark, sf, attack, kinds):
        return clusters.attackers(_scored(spark, sf, attack, kinds), _KIND[attack])

    @query(f"victims_{_attack}", _attack, _kinds)
    def _victims(spark, sf, attack, kinds):
        return clusters.victims(_scored(spark, sf, attack, kinds), _KIND[attack])

    @query(f"victim_history{_suffix}", _attack, _kinds)
    def _victim_history(spark, sf, attack, kinds):
        scored = _scored(spark, sf, attack, kinds).drop("CENTROID", "CENTRE")
        return clusters.victim_history(scored, _KIND[attack])

    @query(f"attackers_enriched{_suffix}", _attack, _kinds)
    def _attackers_enriched(spark, sf, attack, kinds):
        hosts = clusters.attackers(_scored(spark, sf, attack, kinds), _KIND[attack])
        return enrich.enrich(hosts, fx.ip_info(spark, sf), "ID_ORIG_H")

    @query(f"scored_enriched{_suffix}", _attack, _kinds)
    def _scored_enriched(spark, sf, attack, kinds):
        scored = _scored(spark, sf, attack, kinds).drop("CENTROID", "CENTRE")
        return enrich.enrich(scored, fx.ip_info(spark, sf), "ID_ORIG_H")

    for _grain, _name in ((None, "native"), ("hour", "hour")):

        @query(f"pivot_{_attack}_victims_{_name}", _attack, _kinds[0], _grain)
        def _pivot_victims(spark, sf, attack, kind, grain):
            scored = _scored(spark, sf, attack, [kind])
            long = materialize(pivots.victim_counts(scored, _KIND[attack], grain))
            return pivots.spread(long, "ID_RESP_H", plain_names=True)


# Pivots

for _grain in ("hour", "day"):

    @query(f"pivot_proto_{_grain}", _grain)
    def _pivot_proto(spark, sf, grain):
        return pivots.pivot(totals(_conn(spark, sf), "PROTO"), "PROTO", grain)

    @query(f"pivot_service_{_grain}", _grain)
    def _pivot_service(spark, sf, grain):
        rows = totals(_conn(spark, sf), "PROTO_SERVICE")
        return pivots.pivot(rows, "SERVICE", grain)


@query("pivot_orig_h")
def _pivot_orig_h(spark, sf):
    rows = features.ddos_features(_conn(spark, sf), ["http"])
    return pivots.pivot(rows, "ID_ORIG_H", plain_names=True)


@query("pivot_orig_h_http")
def _pivot_orig_h_http(spark, sf):
    rows = totals(_conn(spark, sf), "PROTO_SERVICE_ORIG_H")
    rows = rows.where(F.col("SERVICE") == "http")
    return pivots.pivot(rows, "ID_ORIG_H", "hour", plain_names=True)


@query("pivot_orig_h_wide_file")
def _pivot_orig_h_wide_file(spark, sf):
    """Sources of http traffic as columns, in files of 100 at most, written and read back as long rows."""
    rows = totals(fx.arrivals(spark, sf), "PROTO_SERVICE_ORIG_H").where("SERVICE = 'http'")
    path = scratch_folder(spark)
    write_wide(pivots.history(rows, "ID_ORIG_H", "hour"), "ID_ORIG_H", path, 100)
    return read_wide(spark, path, "ID_ORIG_H")


for _attack, _kinds in _KINDS.items():
    for _kind in _kinds:

        @query(f"victims_wide_file_{_attack}_{_kind}", _attack, _kind)
        def _victims_wide_file(spark, sf, attack, kind):
            """The victims' hourly history in wide files, read back as long rows."""
            scored, path = _scored(spark, sf, attack, [kind]), scratch_folder(spark)
            long = pivots.victim_counts(scored, _KIND[attack], "hour")
            write_wide(long, "ID_RESP_H", path, 2)
            return read_wide(spark, path, "ID_RESP_H")


# Files


@query("export_csv_roundtrip")
def _export_csv_roundtrip(spark, sf):
    path = scratch_folder(spark)
    write_csv(records.conn_records(fx.raw_log(spark, sf)), path)
    return tables.read_table(spark, path, "csv", CONN_SCHEMA, header="true")


@query("export_json_roundtrip")
def _export_json_roundtrip(spark, sf):
    path = scratch_folder(spark)
    write_json(records.dns_records(fx.raw_log(spark, sf)), path)
    return tables.read_table(spark, path, "json", DNS_SCHEMA)
