"""SQL equivalents of the queries, for DuckDB on the same tables."""

from __future__ import annotations

from .. import fixtures as fx
from ..operators.exports import EXPORTED
from ..plans.detection import DDOS_SERVICES, SCAN_PROTOS
from ..schemas import (
    CONN_SCHEMA,
    DDOS_KEYS,
    DEFAULT_TOTAL_TYPES,
    DNS_SCHEMA,
    ENDPOINTS,
    GROUP_COLUMNS,
    HTTP_SCHEMA,
    MEASURES,
    SCAN_KEYS,
    TOTAL_TYPES,
)
from . import queries as q

_TABLES = {n: n for n in ("events", "nation", "region", "customer")}

_LOG = (
    f"conn AS ({fx.CONN_SQL}), dns AS ({fx.DNS_SQL}), "
    f"http AS ({fx.HTTP_SQL}), info AS ({fx.IP_INFO_SQL}), arrivals AS ({fx.ARRIVALS_SQL})"
).format(**_TABLES)

_COUNT = 'CAST(COUNT(*) AS BIGINT) AS "COUNT"'
_SUM_COUNT = 'CAST(SUM("COUNT") AS BIGINT) AS "COUNT"'
_SUMS = ", ".join(
    f"SUM({m}) AS {m}" if m == "DURATION" else f"CAST(SUM({m}) AS BIGINT) AS {m}"
    for m in MEASURES
)
_INFO = "HOSTNAME, CITY, REGION, COUNTRY, ORG, LATITUDE, LONGITUDE"
_EARLY, _LATE = f"TIMESTAMP '{q.EARLY_RUN}'", f"TIMESTAMP '{q.LATE_RUN}'"


def _with(select: str, **ctes: str) -> str:
    more = "".join(f", {name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH RECURSIVE {_LOG}{more} {select}"


def _names(columns: list[str]) -> str:
    return ", ".join(columns)


def _totals(tipo: str, rows: str = "conn", wide: bool = False) -> str:
    keys = TOTAL_TYPES[tipo]
    shown = keys
    if wide:
        types = {"ID_ORIG_P": "INT", "ID_RESP_P": "INT"}
        shown = [
            c if c in keys else f"CAST(NULL AS {types.get(c, 'STRING')}) AS {c}"
            for c in GROUP_COLUMNS
        ]
    return (
        f"SELECT '{tipo}' AS TIPO, date_trunc('hour', TS) AS TS, {_names(shown)}, "
        f"{_COUNT}, {_SUMS} FROM {rows} GROUP BY date_trunc('hour', TS), {_names(keys)}"
    )


def _totals_union(tipos: list[str], rows: str = "conn") -> str:
    return " UNION ALL ".join(_totals(t, rows, wide=True) for t in tipos)


_SINCE_CONN = f"SELECT * FROM conn WHERE TS > TIMESTAMP '{q.SINCE}'"
# From the start of the hour on, as the jobs select.
_FROM_CONN = f"SELECT * FROM conn WHERE TS >= date_trunc('hour', TIMESTAMP '{q.SINCE}')"


def _features(attack: str, kinds: list[str], rows: str = "conn") -> str:
    keys, grain = (DDOS_KEYS, "minute") if attack == "ddos" else (SCAN_KEYS, "hour")
    listed = ", ".join(f"'{k}'" for k in kinds)
    return (
        f"SELECT {_names(keys)}, date_trunc('{grain}', TS) AS TS, {_COUNT}, {_SUMS} "
        f"FROM {rows} WHERE {_KIND[attack]} IN ({listed}) "
        f"GROUP BY {_names(keys)}, date_trunc('{grain}', TS)"
    )


_KIND = {"ddos": "SERVICE", "scan": "PROTO"}
_KINDS = {"ddos": DDOS_SERVICES, "scan": SCAN_PROTOS}


def _scored(attack: str, kinds: list[str], prefix: str = "") -> dict[str, str]:
    """CTEs up to ``scored``: the best split of COUNT in two, for each kind.

    In one dimension two clusters are a cut between two values. Running sums
    give the squared error of each cut, so the best one is exact.
    """
    kind = _KIND[attack]
    before = f"OVER (PARTITION BY {kind} ORDER BY v)"
    whole = f"OVER (PARTITION BY {kind})"
    return {
        "feat": _features(attack, kinds),
        "hist": f'SELECT {kind}, CAST("COUNT" AS HUGEINT) AS v, '
        f'CAST(COUNT(*) AS HUGEINT) AS n FROM {prefix}feat GROUP BY {kind}, "COUNT"',
        "sums": f"SELECT {kind}, v, SUM(n) {before} AS n1, SUM(n * v) {before} AS s1, "
        f"SUM(n) {whole} AS nt, SUM(n * v) {whole} AS st FROM {prefix}hist",
        # What a cut explains of the error, up to a factor.
        "cuts": f"SELECT {kind}, v, ROW_NUMBER() OVER (PARTITION BY {kind} ORDER BY "
        "CAST(nt * s1 - n1 * st AS DOUBLE) * CAST(nt * s1 - n1 * st AS DOUBLE) "
        "/ (CAST(n1 AS DOUBLE) * CAST(nt - n1 AS DOUBLE)) DESC, v) AS place "
        f"FROM {prefix}sums WHERE n1 < nt",
        "labelled": f'SELECT {prefix}feat.*, CASE WHEN "COUNT" > v THEN 1 ELSE 0 END AS PREDICTION '
        f"FROM {prefix}feat LEFT JOIN (SELECT * FROM {prefix}cuts WHERE place = 1) c USING ({kind})",
        "scored": 'SELECT *, AVG("COUNT") OVER '
        f"(PARTITION BY {kind}, PREDICTION) AS CENTRE FROM {prefix}labelled",
    }


def _lloyd(columns: list[str], rows: str) -> dict[str, str]:
    """CTEs up to ``labelled``: two clusters by Lloyd's iterations from the least and the greatest row."""
    names = _names(columns)

    def apart(centre: str) -> str:
        parts = [f"CAST({c} AS DOUBLE) - {centre}[{i}]" for i, c in enumerate(columns, start=1)]
        return " + ".join(f"({p}) * ({p})" for p in parts)

    def mean(label: int) -> str:
        sums = [
            f"CAST(SUM({c}) FILTER (WHERE label = {label}) AS DOUBLE) "
            f"/ COUNT(*) FILTER (WHERE label = {label})"
            for c in columns
        ]
        return f"CASE WHEN COUNT(*) FILTER (WHERE label = {label}) = 0 THEN c{label} ELSE [{', '.join(sums)}] END"

    doubles = ", ".join(f"CAST({c} AS DOUBLE)" for c in columns)
    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    desc = ", ".join(f"{c} DESC" for c in columns)
    near = f"CASE WHEN {apart('c1')} < {apart('c0')} THEN 1 ELSE 0 END"
    return {
        "points": f"SELECT * FROM ({rows}) WHERE {full}",
        "rounds": f"SELECT 0 AS step, (SELECT [{doubles}] FROM points ORDER BY {names} LIMIT 1) AS c0, "
        f"(SELECT [{doubles}] FROM points ORDER BY {desc} LIMIT 1) AS c1 UNION ALL "
        f"SELECT step + 1, {mean(0)}, {mean(1)} "
        f"FROM (SELECT rounds.*, points.*, {near} AS label FROM rounds, points) "
        f"GROUP BY step, c0, c1 HAVING {mean(0)} <> c0 OR {mean(1)} <> c1",
        "final": "SELECT * FROM rounds ORDER BY step DESC LIMIT 1",
        "labelled": "SELECT p.* EXCLUDE (c0, c1, label, e0, e1), CASE WHEN c0 <= c1 THEN label ELSE 1 - label END AS PREDICTION, "
        "CASE WHEN label = 0 THEN e0 ELSE e1 END AS SQ_ERROR FROM "
        f"(SELECT points.*, c0, c1, {near} AS label, {apart('c0')} AS e0, {apart('c1')} AS e1 "
        "FROM points, final) p",
    }


def _pivot(ctes: dict[str, str], rows: str, column: str, values: list, ts: str) -> str:
    cells = ", ".join(
        f'CAST(SUM("COUNT") FILTER (WHERE {column} '
        + (f"= '{v}'" if v is not None else "IS NULL")
        + f') AS BIGINT) AS "{"null" if v is None else v.replace(".", "_")}"'
        for v in values
    )
    return _with(f"SELECT {ts} AS TS, {cells} FROM ({rows}) GROUP BY 1", **ctes)


_PROTOS = ["icmp", "tcp", "udp"]
_SERVICES = [None, "dns", "http", "ssh", "ssl"]
# The sources of http traffic in the log: 60 hosts by user, and the burst host.
_SOURCES = ["10.9.9.9"] + [f"10.0.{a}.{b}" for a in range(3) for b in range(20)]
_VICTIMS = ["200.18.0.80"]


def _enriched(rows: str, field: str) -> str:
    return f"SELECT r.*, {_INFO} FROM ({rows}) r LEFT JOIN info ON r.{field} = info.IP"


def all_oracles() -> dict[str, str]:
    sql: dict[str, str] = {}

    # Row selections and extracts
    raw_columns = _names(CONN_SCHEMA.names[1:] + DNS_SCHEMA.names[9:])
    raw = (
        "SELECT * FROM conn UNION ALL BY NAME SELECT * FROM dns "
        "UNION ALL BY NAME SELECT * FROM http"
    )
    sql["select_recent"] = _with(
        f"SELECT TIPO, {raw_columns} FROM ({raw}) WHERE TS_CODE > TIMESTAMP '{q.SINCE}'"
    )
    conn_columns = _names(CONN_SCHEMA.names)
    recent_conn = f"SELECT {conn_columns} FROM conn WHERE TS > TIMESTAMP '{q.SINCE}'"
    sql["select_conn"] = _with(recent_conn)
    sql["select_results"] = _with(
        f"SELECT {conn_columns} FROM conn WHERE TS_CODE > TIMESTAMP '{q.SINCE}'"
    )
    sql["select_totals"] = _with(
        f'SELECT TIPO, TS, ID_ORIG_H, ID_RESP_H, "COUNT", {_LATE} AS TS_CODE FROM t',
        late=_SINCE_CONN,
        t=_totals("ORIG_H_RESP_H", "late"),
    )
    sql["select_scores"] = _with(
        f"SELECT *, {_LATE} AS TS_CODE FROM f",
        late=_SINCE_CONN,
        f=_features("ddos", DDOS_SERVICES, "late"),
    )
    for kind, schema in (("conn", CONN_SCHEMA), ("dns", DNS_SCHEMA), ("http", HTTP_SCHEMA)):
        sql[f"{kind}_records"] = _with(f"SELECT {_names(schema.names)} FROM {kind}")
    sql["export_csv_roundtrip"] = sql["conn_records"]
    sql["export_json_roundtrip"] = sql["dns_records"]

    # DNS
    www = f"SELECT UID, {_names(ENDPOINTS)}, QUERY FROM dns WHERE QUERY LIKE '%www.%'"
    sql["dns_www"] = _with(f"{www} ORDER BY QUERY, UID")
    sides = "PROTO, SERVICE, DURATION, ORIG_BYTES, RESP_BYTES"
    joined = (
        f"SELECT DISTINCT c.UID, {', '.join('c.' + e for e in ENDPOINTS)}, "
        f"{', '.join('c.' + s for s in sides.split(', '))}, www.QUERY "
        "FROM www JOIN conn c ON www.UID = c.UID"
    )
    sql["conn_by_dns_query"] = _with(f"{joined} ORDER BY ORIG_BYTES DESC", www=www)
    sql["conn_www_sum"] = _with(
        "SELECT QUERY, SUM(DURATION) AS DURATION, "
        "CAST(SUM(ORIG_BYTES) AS BIGINT) AS ORIG_BYTES, "
        "CAST(SUM(RESP_BYTES) AS BIGINT) AS RESP_BYTES FROM j GROUP BY QUERY "
        "ORDER BY RESP_BYTES DESC",
        www=www,
        j=joined,
    )

    # Totals
    for tipo in TOTAL_TYPES:
        sql[f"totals_{tipo.lower()}"] = _with(_totals(tipo))
    for tipo in EXPORTED:
        keys = _names(TOTAL_TYPES[tipo])
        sql[f"export_totals_{tipo.lower()}"] = _with(
            f"SELECT * FROM ({_totals(tipo)}) ORDER BY TS, {keys}"
        )
    sql["totals_all"] = _with(_totals_union(DEFAULT_TOTAL_TYPES))
    sql["totals_all_23"] = _with(_totals_union(list(TOTAL_TYPES)))
    sql["totals_rolled_up"] = _with(
        _totals_union(q.ROLLED_UP)
    )
    sql["totals_stored"] = _with(
        _totals_union(
            ["PROTO_SERVICE_RESP_H_P", "ORIG_H_RESP_H", *q.ROLLED_UP], "late"
        ),
        late=_FROM_CONN,
    )
    sql["results_upsert"] = _with(
        "SELECT * EXCLUDE (place) FROM (SELECT *, ROW_NUMBER() OVER "
        "(PARTITION BY TIPO, TS, PROTO, SERVICE ORDER BY TS_CODE DESC) AS place "
        "FROM runs) WHERE place = 1",
        late=_FROM_CONN,
        runs=f"SELECT *, {_EARLY} AS TS_CODE FROM ({_totals('PROTO_SERVICE')}) "
        f"UNION ALL SELECT *, {_LATE} AS TS_CODE FROM ({_totals('PROTO_SERVICE', 'late')})",
    )

    sql["results_compacted"] = sql["results_base_and_run"] = sql["results_upsert"]
    sql["totals_two_runs"] = sql["totals_all"]
    for attack, kinds in _KINDS.items():
        sql[f"scores_two_runs_{attack}"] = _with(_features(attack, kinds))
        sql[f"detection_fit_{attack}"] = _with(
            f"SELECT {_KIND[attack]}, PREDICTION, ROUND(CENTRE, 6) AS CENTRE, "
            'CAST(COUNT(*) AS BIGINT) AS "ROWS", '
            'ROUND(SUM(("COUNT" - CENTRE) * ("COUNT" - CENTRE)), 6) AS WSSSE '
            f"FROM scored GROUP BY {_KIND[attack]}, PREDICTION, CENTRE",
            **_scored(attack, kinds),
        )

    # The log by days, and records that arrive late
    for name, column in (("select_conn_by_day", "TS"), ("select_recent_by_day", "TS_CODE")):
        sql[name] = _with(
            f"SELECT {conn_columns} FROM arrivals WHERE {column} > TIMESTAMP '{q.AFTER}'"
        )
    sql["totals_late_records"] = _with(_totals_union(DEFAULT_TOTAL_TYPES, "arrivals"))
    for attack, kinds in _KINDS.items():
        sql[f"scores_late_records_{attack}"] = _with(_features(attack, kinds, "arrivals"))
    for column, tipo, values in (
        ("PROTO", "PROTO", _PROTOS), ("SERVICE", "PROTO_SERVICE", _SERVICES)
    ):
        sql[f"pivot_{column.lower()}_30_days"] = _pivot(
            {}, _totals(tipo, "arrivals"), column, values, "date_trunc('day', TS)"
        )

    # Rankings
    sql["top_conn_by_bytes"] = _with(
        "SELECT UID, TS, ID_ORIG_H, ID_RESP_H, ORIG_BYTES FROM conn "
        "ORDER BY ORIG_BYTES DESC NULLS LAST, UID LIMIT 100"
    )
    inbound = f"SELECT * FROM pairs WHERE ID_RESP_H LIKE '{q.PREFIX}%'"
    pairs = _totals("ORIG_H_RESP_H")
    responders = _totals("PROTO_SERVICE_RESP_H")

    def ranking(rows: str, host: str) -> str:
        return (
            f"SELECT {host}, {_SUM_COUNT} FROM ({rows}) GROUP BY {host} "
            f'ORDER BY "COUNT" DESC, {host}'
        )

    sql["inbound_to_prefix"] = _with(inbound, pairs=pairs)
    sql["orig_h_ranking"] = _with(ranking(inbound, "ID_ORIG_H"), pairs=pairs)
    sql["resp_h_ranking"] = _with(ranking(responders, "ID_RESP_H"))

    # Enrichment
    sql["distinct_ips"] = _with("SELECT DISTINCT ID_RESP_H FROM conn")
    known = f"SELECT IP, {_INFO}, TS_CODE FROM info WHERE IP IN (SELECT ID_ORIG_H FROM conn)"
    missing = (
        "SELECT DISTINCT ID_ORIG_H FROM conn c "
        "WHERE NOT EXISTS (SELECT 1 FROM info WHERE IP = c.ID_ORIG_H)"
    )
    candidates = (
        f"SELECT ID_ORIG_H, {_SUM_COUNT} FROM pairs p "
        "WHERE NOT EXISTS (SELECT 1 FROM info WHERE IP = p.ID_ORIG_H) "
        f'GROUP BY ID_ORIG_H ORDER BY "COUNT" DESC, ID_ORIG_H LIMIT {q.LOOKUPS}'
    )
    sql["ipinfo_known"] = _with(known)
    sql["ipinfo_missing"] = _with(missing)
    sql["lookup_candidates"] = _with(candidates, pairs=pairs)
    sql["lookup_quota"] = _with(
        "SELECT CAST(GREATEST(0, 1000 - COUNT(*)) AS BIGINT) AS QUOTA FROM info "
        f"WHERE TS_CODE > TIMESTAMP '{q.TODAY}'"
    )
    last = "CAST(split_part(ID_ORIG_H, '.', 4) AS INT)"
    answered = "CASE WHEN ID_ORIG_H NOT LIKE '10.0.2.%'"
    sql["ipinfo_union"] = _with(
        f"{known} UNION ALL SELECT ID_ORIG_H, {answered} THEN concat('host-', ID_ORIG_H) END, "
        f"{answered} AND {last} % 2 = 1 THEN 'unknown' END, NULL, NULL, NULL, "
        f"{answered} THEN {last} + 0.5 END, NULL, {_LATE} FROM cand",
        pairs=pairs,
        cand=candidates,
    )
    sql["report_sources_file"] = _with(
        'SELECT r.ID_ORIG_H, r.ID_RESP_H, r.TS, r."COUNT", i.LATITUDE, i.HOSTNAME, i.CITY, '
        f"i.COUNTRY FROM ({inbound}) r LEFT JOIN answers i ON r.ID_ORIG_H = i.IP",
        pairs=pairs,
        asked=f"SELECT DISTINCT ID_ORIG_H FROM ({inbound}) p "
        "WHERE NOT EXISTS (SELECT 1 FROM info WHERE IP = p.ID_ORIG_H)",
        answers="SELECT IP, HOSTNAME, CITY, COUNTRY, LATITUDE FROM info UNION ALL "
        "SELECT ID_ORIG_H, concat('host-', ID_ORIG_H), "
        f"CASE WHEN {last} % 2 = 1 THEN 'unknown' END, NULL, {last} + 0.5 FROM asked "
        "WHERE ID_ORIG_H NOT LIKE '10.0.2.%'",
    )
    sql["enrich_resp_h"] = _with(_enriched(responders, "ID_RESP_H"))
    sql["enrich_orig_h"] = _with(_enriched(inbound, "ID_ORIG_H"), pairs=pairs)
    sql["ranked_resp_h_enriched"] = _with(
        _enriched(ranking(responders, "ID_RESP_H"), "ID_RESP_H")
    )
    sql["ranked_orig_h_enriched"] = _with(
        _enriched(ranking(inbound, "ID_ORIG_H"), "ID_ORIG_H"), pairs=pairs
    )

    # Detection
    sql["ddos_features"] = _with(_features("ddos", DDOS_SERVICES))
    sql["scan_features"] = _with(_features("scan", SCAN_PROTOS))
    sizes = (
        "SELECT PREDICTION, ROUND(CENTRE, 6) AS CENTRE, "
        'CAST(COUNT(*) AS BIGINT) AS "ROWS" FROM scored GROUP BY ALL'
    )
    http, tcp = _scored("ddos", ["http"]), _scored("scan", ["tcp"])
    sql["kmeans_train"] = _with(sizes, **http)
    sql["kmeans_centers"] = _with(sizes, **tcp)
    sql["kmeans_wssse"] = _with(
        'SELECT ROUND(SUM(("COUNT" - CENTRE) * ("COUNT" - CENTRE)), 6) AS WSSSE '
        "FROM scored",
        **http,
    )
    # Mean squared distances to both clusters, from sums per cluster.
    ctes, parts = {}, []
    for attack, kinds in _KINDS.items():
        kind = _KIND[attack]
        ctes |= {f"{attack}_{name}": sql for name, sql in _scored(attack, kinds, f"{attack}_").items()}
        ctes[f"{attack}_per"] = (
            f'SELECT {kind}, PREDICTION, COUNT(*) AS n, CAST(SUM("COUNT") AS DOUBLE) AS s, '
            f'CAST(SUM("COUNT" * "COUNT") AS DOUBLE) AS sq FROM {attack}_scored GROUP BY ALL'
        )
        ctes[f"{attack}_d"] = (
            f'SELECT r.{kind} AS KIND, own.n AS own_n, '
            '("COUNT" * "COUNT" * own.n - 2 * "COUNT" * own.s + own.sq) / (own.n - 1) AS a, '
            '("COUNT" * "COUNT" * oth.n - 2 * "COUNT" * oth.s + oth.sq) / oth.n AS b '
            f"FROM {attack}_scored r JOIN {attack}_per own USING ({kind}, PREDICTION) "
            f"JOIN {attack}_per oth ON oth.{kind} = r.{kind} AND oth.PREDICTION <> r.PREDICTION"
        )
        parts.append(
            "SELECT KIND, ROUND(AVG(CASE WHEN own_n = 1 THEN 0 WHEN a < b THEN 1 - a / b "
            f"WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS SILHOUETTE FROM {attack}_d GROUP BY KIND"
        )
    sql["kmeans_silhouette"] = _with(" UNION ALL ".join(parts), **ctes)
    multi = _lloyd(["DURATION", "ORIG_PKTS", "ORIG_BYTES"], _totals("PROTO_SERVICE_ORIG_H"))
    sql["kmeans_multi"] = _with("SELECT * FROM labelled", **multi)
    sql["kmeans_multi_fit"] = _with(
        "SELECT PREDICTION, ROUND(ANY_VALUE(own[1]), 6) AS DURATION, "
        "ROUND(ANY_VALUE(own[2]), 6) AS ORIG_PKTS, ROUND(ANY_VALUE(own[3]), 6) AS ORIG_BYTES, "
        'CAST(COUNT(*) AS BIGINT) AS "ROWS", ROUND(SUM(SQ_ERROR), 0) AS WSSSE FROM ('
        "SELECT l.*, CASE WHEN PREDICTION = 0 THEN least(c0, c1) ELSE greatest(c0, c1) END AS own "
        "FROM labelled l, final) GROUP BY PREDICTION",
        **multi,
    )
    for attack, kinds in _KINDS.items():
        kind = _KIND[attack]
        suffix = "" if attack == "ddos" else f"_{attack}"
        scored = _scored(attack, kinds)
        for one in kinds:
            sql[f"detect_{attack}_{one}"] = _with(
                "SELECT * REPLACE (ROUND(CENTRE, 6) AS CENTRE) FROM scored",
                **_scored(attack, [one]),
            )
        hosts = f"SELECT DISTINCT {kind}, ID_ORIG_H FROM scored WHERE PREDICTION = 1"
        sql[f"attackers_{attack}"] = _with(hosts, **scored)
        targets = f"SELECT DISTINCT {kind}, ID_RESP_H FROM scored WHERE PREDICTION = 1"
        sql[f"victims_{attack}"] = _with(targets, **scored)
        sql[f"attackers_enriched{suffix}"] = _with(_enriched(hosts, "ID_ORIG_H"), **scored)
        rows = "SELECT * EXCLUDE (CENTRE) FROM scored"
        sql[f"scored_enriched{suffix}"] = _with(_enriched(rows, "ID_ORIG_H"), **scored)
        sql[f"victim_history{suffix}"] = _with(
            f"SELECT l.* FROM labelled l JOIN ({targets}) v USING ({kind}, ID_RESP_H)",
            **scored,
        )
        first = _scored(attack, kinds[:1])
        history = (
            "SELECT * FROM labelled WHERE ID_RESP_H IN "
            "(SELECT ID_RESP_H FROM labelled WHERE PREDICTION = 1)"
        )
        for name, ts in (("native", "TS"), ("hour", "date_trunc('hour', TS)")):
            sql[f"pivot_{attack}_victims_{name}"] = _pivot(
                first, history, "ID_RESP_H", _VICTIMS, ts
            )

        for one in kinds:
            split = _scored(attack, [one])
            sql[f"victims_wide_file_{attack}_{one}"] = _with(
                f"SELECT date_trunc('hour', TS) AS TS, ID_RESP_H, {_SUM_COUNT} "
                f"FROM ({history}) GROUP BY 1, 2",
                **split,
            )

    # Pivots
    sql["pivot_orig_h_wide_file"] = _with(
        f"SELECT TS, ID_ORIG_H, {_SUM_COUNT} FROM ({_totals('PROTO_SERVICE_ORIG_H', 'arrivals')}) "
        "WHERE SERVICE = 'http' GROUP BY TS, ID_ORIG_H"
    )
    for grain in ("hour", "day"):
        ts = f"date_trunc('{grain}', TS)"
        sql[f"pivot_proto_{grain}"] = _pivot({}, _totals("PROTO"), "PROTO", _PROTOS, ts)
        sql[f"pivot_service_{grain}"] = _pivot(
            {}, _totals("PROTO_SERVICE"), "SERVICE", _SERVICES, ts
        )
    sql["pivot_orig_h"] = _pivot(
        {}, _features("ddos", ["http"]), "ID_ORIG_H", _SOURCES, "TS"
    )
    http_totals = f"SELECT * FROM ({_totals('PROTO_SERVICE_ORIG_H')}) WHERE SERVICE = 'http'"
    sql["pivot_orig_h_http"] = _pivot(
        {}, http_totals, "ID_ORIG_H", _SOURCES, "date_trunc('hour', TS)"
    )
    return sql
