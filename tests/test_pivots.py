from datetime import datetime

from pyspark.sql import functions as F

from connlens import fixtures as fx
from connlens.operators.pivots import history, pivot, spread, victim_counts
from connlens.operators.ranking import (
    inbound_to_prefix,
    orig_h_ranking,
    resp_h_ranking,
    top_conn_by_bytes,
)
from connlens.operators.totals import totals, totals_all
from connlens.plans.report import write_history
from logs import as_set, conn_rows

T1, T2 = datetime(2024, 1, 31, 9, 5), datetime(2024, 2, 1, 9, 40)


def rows_at(spark, *rows):
    return spark.createDataFrame(list(rows), "TS timestamp, SERVICE string, COUNT bigint")


def test_missing_value_is_a_column_named_null(spark):
    rows = rows_at(spark, (T1, "http", 1), (T1, None, 2), (T2, "http", 4))
    table = pivot(rows, "SERVICE", "hour")
    assert sorted(table.columns) == ["TS", "http", "null"]
    assert as_set(table, "http", "null") == [(1, 2), (4, None)]


def test_days_come_in_order_of_time(spark):
    rows = rows_at(spark, (T2, "http", 4), (T1, "http", 1), (T1, "http", 2))
    table = pivot(rows, "SERVICE", "day").collect()
    assert [(r["TS"], r["http"]) for r in table] == [
        (datetime(2024, 1, 31), 3),
        (datetime(2024, 2, 1), 4),
    ]


def test_given_values_equal_found_values(spark):
    rows = rows_at(spark, (T1, "a.b", 1), (T2, "c", 2))
    found = pivot(rows, "SERVICE", "hour", plain_names=True)
    given = pivot(rows, "SERVICE", "hour", ["a.b", "c"], plain_names=True)
    assert found.columns == given.columns == ["TS", "a_b", "c"]
    assert as_set(found) == as_set(given)


def test_cells_add_up_to_the_long_form(spark, small):
    rows = totals(fx.conn_log(spark, small), "PROTO_SERVICE_ORIG_H")
    long = history(rows, "ID_ORIG_H", "hour")
    table = spread(long, "ID_ORIG_H", plain_names=True)
    cells = sum(F.coalesce(F.col(c), F.lit(0)) for c in table.columns if c != "TS")
    wide = {r["TS"]: r["n"] for r in table.select("TS", cells.alias("n")).collect()}
    tall = long.groupBy("TS").agg(F.sum("COUNT").alias("n")).collect()
    assert wide == {r["TS"]: r["n"] for r in tall}


def test_a_history_file_has_the_layout_asked_for(spark, tmp_path):
    rows = rows_at(spark, (T1, "a", 1), (T1, "b", 2), (T2, "a", 3))
    long = history(rows, "SERVICE", "hour")
    written = {}
    for wide in (True, False):
        path = str(tmp_path / str(wide))
        write_history(long, "SERVICE", path, "hour", wide)
        table = spark.read.csv(path, header=True)
        written[wide] = (table.columns, as_set(table))
    assert written[True] == (
        ["TS", "a", "b"], [("01.02.2024 09", "3", None), ("31.01.2024 09", "1", "2")],
    )
    assert written[False] == (
        ["TS", "SERVICE", "COUNT"],
        [("01.02.2024 09", "a", "3"), ("31.01.2024 09", "a", "1"), ("31.01.2024 09", "b", "2")],
    )


def test_a_long_history_has_any_number_of_hosts(spark, tmp_path):
    hosts = spark.range(20_000).select(
        F.lit("2024-01-01 10:00:00").cast("timestamp").alias("TS"),
        F.col("id").cast("string").alias("ID_RESP_H"),
        F.lit(1).cast("bigint").alias("COUNT"),
    )
    write_history(hosts, "ID_RESP_H", str(tmp_path / "H"), "hour", wide=False)
    file = spark.read.csv(str(tmp_path / "H"), header=True)
    assert file.columns == ["TS", "ID_RESP_H", "COUNT"] and file.count() == 20_000


def test_history_of_victims_only(spark):
    rows = spark.createDataFrame(
        [
            (T1, "http", "v", 1, 50),
            (T1, "http", "v", 0, 1),
            (T2, "http", "v", 0, 2),
            (T1, "http", "w", 0, 7),
        ],
        "TS timestamp, SERVICE string, ID_RESP_H string, PREDICTION int, COUNT bigint",
    )
    assert as_set(victim_counts(rows, "SERVICE"), "ID_RESP_H", "COUNT") == [
        ("v", 2),
        ("v", 51),
    ]


def test_hourly_scores_have_equal_native_and_hourly_histories(spark):
    hour = datetime(2024, 1, 1, 9)
    rows = spark.createDataFrame(
        [(hour, "tcp", "v", 1, 300)],
        "TS timestamp, PROTO string, ID_RESP_H string, PREDICTION int, COUNT bigint",
    )
    native, hourly = (victim_counts(rows, "PROTO", g) for g in (None, "hour"))
    assert as_set(native) == as_set(hourly)


def test_prefix_is_of_the_target_and_dots_are_dots(spark):
    log = conn_rows(
        spark,
        {"ID_RESP_H": "200.18.1.1"},
        {"ID_RESP_H": "200.180.1.1"},
        {"ID_ORIG_H": "200.18.1.1", "ID_RESP_H": "9.9.9.9"},
    )
    every = totals_all(log)
    assert as_set(inbound_to_prefix(every, "200.18."), "ID_RESP_H") == [("200.18.1.1",)]


def test_rankings_add_up_and_break_ties_by_host(spark):
    log = conn_rows(
        spark,
        {"ID_RESP_H": "b"},
        {"ID_RESP_H": "a"},
        {"ID_RESP_H": "c", "SERVICE": "ssh"},
        {"ID_RESP_H": "c", "TS": T2},
    )
    ranked = resp_h_ranking(totals_all(log)).collect()
    assert [tuple(r) for r in ranked] == [("c", 2), ("a", 1), ("b", 1)]
    hosts = spark.range(10_050).selectExpr(
        "'PROTO_SERVICE_RESP_H' AS TIPO", "CAST(id AS STRING) AS ID_RESP_H", "id AS COUNT"
    )
    assert resp_h_ranking(hosts).count() == 10_050
    inbound = orig_h_ranking(totals_all(log), "c").collect()
    assert [tuple(r) for r in inbound] == [("10.0.0.1", 2)]


def test_top_connections(spark):
    log = conn_rows(
        spark,
        {"UID": "1", "ORIG_BYTES": None},
        {"UID": "2", "ORIG_BYTES": 5},
        {"UID": "3", "ORIG_BYTES": 9},
    )
    assert [r["UID"] for r in top_conn_by_bytes(log, 2).collect()] == ["3", "2"]
