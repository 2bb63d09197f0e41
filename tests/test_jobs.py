"""The jobs end to end: stored log in, stored results and files out."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from connlens import fixtures as fx
from connlens.operators.clusters import train
from connlens.operators.features import ddos_features
from connlens.operators.totals import totals_all
from connlens.plans.detection import run_ddos, run_scan
from connlens.plans.enrichment import Lookups
from connlens.plans.extract import extract, inspect
from connlens.plans.report import (
    report_all,
    report_ddos,
    report_responders,
    report_sources,
)
from connlens.plans.totals import add_totals, run_totals
from connlens.schemas import DEFAULT_TOTAL_TYPES, DDOS_SCHEMA, TOTALS_SCHEMA
from connlens.sinks import has_model, load_model, read_results, save_model
from connlens.sources.tables import select_conn
from logs import as_set

START = "2023-12-31 00:00:00"
RUN = datetime(2024, 2, 1, 12)
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A stored log with its totals, scores, models and IP_INFO."""
    root = tmp_path_factory.mktemp("store")
    fx.raw_log(spark, SF).write.partitionBy("TIPO").parquet(str(root / "LOG"))
    fx.ip_info(spark, SF).write.parquet(str(root / "IP_INFO"))
    raw = spark.read.parquet(str(root / "LOG"))
    run_totals(raw, START, RUN, str(root / "TOTALS"))
    run_ddos(raw, START, RUN, str(root / "DDOS"), str(root / "models/ddos"))
    run_scan(raw, START, RUN, str(root / "SCAN"), str(root / "models/scan"))
    return root


def table(spark, store, name):
    return read_results(spark, str(store / name), run_ts=RUN)


def csv(spark, folder):
    return spark.read.csv(str(folder), header=True)


def test_totals_job(spark, store):
    stored = table(spark, store, "TOTALS")
    assert sorted(stored.columns) == sorted(TOTALS_SCHEMA.names)
    expected = totals_all(fx.conn_log(spark, SF))
    assert as_set(stored, *expected.columns) == as_set(expected)
    tags = stored.select("TS_FILTRO", "TS_CODE").distinct()
    assert as_set(tags) == [(datetime(2023, 12, 31), RUN)]


def test_totals_added_from_stored_ones(spark, store, tmp_path):
    path = str(tmp_path / "T")
    raw = spark.read.parquet(str(store / "LOG"))
    run_totals(raw, START, RUN, path, ["ORIG_H_P_RESP_H_P"])
    add_totals(spark, START, RUN, path, "ORIG_H_P_RESP_H_P", ["ORIG_H_P", "RESP_P"])
    added = read_results(spark, path, run_ts=RUN).where("TIPO <> 'ORIG_H_P_RESP_H_P'")
    expected = totals_all(fx.conn_log(spark, SF), ["ORIG_H_P", "RESP_P"])
    assert as_set(added, *expected.columns) == as_set(expected)
    with pytest.raises(ValueError, match="PROTO"):
        add_totals(spark, START, RUN, path, "ORIG_H_P_RESP_H_P", ["PROTO"])


def test_detection_trains_once_and_then_loads(spark, store, tmp_path):
    raw = spark.read.parquet(str(store / "LOG"))
    models = str(store / "models/ddos")
    assert has_model(spark, f"{models}/http") and has_model(spark, f"{models}/ssh")
    stored = table(spark, store, "DDOS")
    assert sorted(stored.columns) == sorted(DDOS_SCHEMA.names)
    again = str(tmp_path / "DDOS")
    run_ddos(raw, START, RUN, again, models)
    columns = [c for c in DDOS_SCHEMA.names if c != "ROW_ID"]
    assert as_set(read_results(spark, again, run_ts=RUN), *columns) == as_set(stored, *columns)

    own = str(tmp_path / "models")
    rows = ddos_features(select_conn(raw), ["http"])
    model = train(rows.where("COUNT < 3"))
    save_model(spark, model, f"{own}/http")
    run_ddos(raw, START, RUN, str(tmp_path / "X"), own, ["http"])
    scored = read_results(spark, str(tmp_path / "X"), run_ts=RUN)
    assert scored.first()["CENTROID"] == model
    run_ddos(raw, START, RUN, str(tmp_path / "Y"), own, ["http"], retrain=True)
    assert load_model(spark, f"{own}/http")[1] == 30.0


def test_kinds_without_rows_are_left_out(spark, store, tmp_path):
    raw = spark.read.parquet(str(store / "LOG"))
    path, models = str(tmp_path / "D"), str(tmp_path / "models")
    run_ddos(raw, START, RUN, path, models, ["http", "gopher"])
    assert as_set(read_results(spark, path, run_ts=RUN).select("SERVICE").distinct()) == [("http",)]
    assert not has_model(spark, f"{models}/gopher")


def test_extract_job(spark, store, tmp_path):
    extract(spark.read.parquet(str(store / "LOG")), START, str(tmp_path))
    names = ("CONN-ALL", "DNS-ALL", "HTTP-ALL", "CONN-WWW", "CONN-WWW-SUM")
    rows = [csv(spark, tmp_path / name).count() for name in names]
    assert rows == [10_000, 2017, 2006, 692, 10]


def test_inspect_job(spark, store, capsys):
    inspect(spark.read.parquet(str(store / "LOG")), START)
    assert "NEW: 14023 rows" in capsys.readouterr().out


def test_sources_report_with_lookups(spark, store, tmp_path):
    folder = str(tmp_path / "IP_INFO")
    spark.read.parquet(str(store / "IP_INFO")).write.parquet(folder)
    totals = table(spark, store, "TOTALS")

    def provider():
        return lambda ip: {"hostname": f"h-{ip}"}

    info = spark.read.parquet(folder)
    before = info.count()
    ranked = report_sources(
        totals, info, START, RUN, str(tmp_path), "200.18.", Lookups(provider(), folder)
    )
    assert ranked.where(F.col("HOSTNAME").isNull()).isEmpty()
    added = spark.read.parquet(folder).where(F.col("TS_CODE") == F.lit(RUN))
    assert 0 < added.count() == spark.read.parquet(folder).count() - before
    file = csv(spark, tmp_path / "ORIG_H_RESP_H_INFO_WEB")
    assert file.count() == 1779
    assert {"HOSTNAME", "COUNTRY"} <= set(file.columns)
    assert file.where("HOSTNAME IS NULL").isEmpty()


def test_whole_report_keeps_the_allowance(spark, store, tmp_path):
    folder = str(tmp_path / "IP_INFO")
    spark.read.parquet(str(store / "IP_INFO")).where("IP LIKE '172.%'").write.parquet(folder)
    info = spark.read.parquet(folder)
    tables = [table(spark, store, name) for name in ("TOTALS", "DDOS", "SCAN")]

    def provider():
        def ask(ip):
            raise RuntimeError("no answer")

        return ask

    def run(run_ts, **more):
        lookups = Lookups(provider(), folder, per_day=2, **more)
        report_all(*tables, info, START, run_ts, str(tmp_path / "out"), lookups)
        asked = spark.read.parquet(folder).where("IP NOT LIKE '172.%'")
        return [r["IP"] for r in asked.collect()]

    first = run(RUN)
    assert len(first) == len(set(first)) == 2
    # The allowance is used up, then others are asked, and failures only when it is time.
    assert sorted(run(RUN)) == sorted(first)
    then = run(RUN + timedelta(days=1))
    assert len(then) == len(set(then)) == 4
    again = run(RUN + timedelta(days=2), retry_before=RUN + timedelta(hours=1))
    assert len(again) == 6 and len(set(again)) == 4


def test_responders_report(spark, store, tmp_path):
    info = spark.read.parquet(str(store / "IP_INFO"))
    totals = table(spark, store, "TOTALS")
    ranked = report_responders(totals, info, START, RUN, str(tmp_path))
    assert ranked.count() == 49
    assert csv(spark, tmp_path / "PROTO_SERVICE_RESP_H_INFO_WEB").count() == 1436


def test_whole_report(spark, store, tmp_path):
    report_all(
        table(spark, store, "TOTALS"),
        table(spark, store, "DDOS"),
        table(spark, store, "SCAN"),
        spark.read.parquet(str(store / "IP_INFO")),
        START,
        RUN,
        str(tmp_path),
    )
    names = {p.name for p in tmp_path.iterdir()}
    expected = {"PROTO_SERVICE_RESP_H_INFO_WEB", *DEFAULT_TOTAL_TYPES}
    for tipo in ("PROTO", "PROTO_SERVICE"):
        expected |= {f"{tipo}_{tipo}_PIVOT_{g}" for g in "HD"}
    for kind in ("DDoS_http", "DDoS_ssh", "Scan_tcp", "Scan_udp"):
        expected |= {kind, f"{kind}_PIVOT_M", f"{kind}_PIVOT_H"}
    assert names == expected
    services = csv(spark, tmp_path / "PROTO_SERVICE_PROTO_SERVICE_PIVOT_H")
    assert services.columns == ["TS", "null", "dns", "http", "ssh", "ssl"]
    assert services.first()["TS"] == "01.01.2024 00"
    victims = csv(spark, tmp_path / "DDoS_http_PIVOT_M")
    assert victims.columns == ["TS", "ID_RESP_H", "COUNT"]
    assert victims.count() == 50
    assert "CENTROID" not in csv(spark, tmp_path / "DDoS_http").columns


def test_attackers_come_back_enriched(spark, store, tmp_path):
    found = report_ddos(
        table(spark, store, "DDOS"),
        spark.read.parquet(str(store / "IP_INFO")),
        START,
        RUN,
        str(tmp_path),
        services=["http"],
    )
    rows = as_set(found["http"], "ID_ORIG_H", "HOSTNAME")
    assert rows == [("10.9.9.9", None)]
