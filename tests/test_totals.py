import time
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from connlens import fixtures as fx
from connlens.functions import BUCKET_FORMATS, bucket, bucket_from_text, bucket_text
from connlens.operators.exports import EXPORTED, busiest_first, totals_export, with_text_time
from connlens.operators.totals import (
    TOTAL_COLUMNS,
    roll_up,
    tag_run,
    totals,
    totals_all,
    with_row_id,
)
from connlens.schemas import MEASURES, TOTAL_TYPES
from connlens.sources.tables import select_conn
from logs import as_set, conn_rows


def test_hour_group_sums_and_count(spark):
    log = conn_rows(
        spark,
        {"TS": datetime(2024, 1, 1, 10, 0)},
        {"TS": datetime(2024, 1, 1, 10, 59, 59), "ORIG_BYTES": 5},
        {"TS": datetime(2024, 1, 1, 11, 0)},
    )
    rows = as_set(totals(log, "PROTO"), "TS", "PROTO", "COUNT", "ORIG_BYTES", "DURATION")
    assert rows == [
        (datetime(2024, 1, 1, 10), "tcp", 2, 15, 1.0),
        (datetime(2024, 1, 1, 11), "tcp", 1, 10, 0.5),
    ]


def test_missing_service_is_a_group_of_its_own(spark):
    log = conn_rows(spark, {"SERVICE": None}, {"SERVICE": None}, {})
    rows = as_set(totals(log, "PROTO_SERVICE"), "SERVICE", "COUNT")
    assert rows == [("http", 1), (None, 2)]


def test_sums_skip_nulls_and_are_null_without_any_value(spark):
    log = conn_rows(
        spark,
        {"DURATION": None, "PROTO": "icmp"},
        {"DURATION": None, "PROTO": "udp"},
        {"DURATION": 2.0, "PROTO": "udp"},
    )
    rows = as_set(totals(log, "PROTO"), "PROTO", "DURATION", "COUNT")
    assert rows == [("icmp", None, 1), ("udp", 2.0, 2)]


def test_empty_log_gives_no_totals(spark):
    empty = conn_rows(spark, {}).limit(0)
    assert totals(empty, "PROTO").isEmpty()
    assert totals_all(empty).isEmpty()


def test_one_pass_equals_single_totals_for_all_types(spark, small):
    log = select_conn(fx.raw_log(spark, small))
    every = totals_all(log, list(TOTAL_TYPES)).cache()
    assert every.columns == TOTAL_COLUMNS
    for tipo, keys in TOTAL_TYPES.items():
        columns = ["TIPO", "TS", *keys, "COUNT", *MEASURES]
        one_pass = every.where(F.col("TIPO") == tipo)
        assert as_set(one_pass, *columns) == as_set(totals(log, tipo), *columns), tipo
        absent = [c for c in TOTAL_TYPES["ORIG_H_P_RESP_H_P"] if c not in keys]
        assert all(one_pass.where(F.col(c).isNotNull()).isEmpty() for c in absent)
    every.unpersist()


def test_counts_of_every_type_add_up_to_the_log(spark, small):
    log = select_conn(fx.raw_log(spark, small))
    counts = totals_all(log, list(TOTAL_TYPES)).groupBy("TIPO").agg(F.sum("COUNT"))
    assert as_set(counts) == sorted((t, 1000) for t in TOTAL_TYPES)


def test_null_key_and_absent_key_are_told_apart(spark):
    log = conn_rows(spark, {"SERVICE": None})
    rows = as_set(totals_all(log, ["PROTO", "PROTO_SERVICE"]), "TIPO", "PROTO", "SERVICE")
    assert rows == [("PROTO", "tcp", None), ("PROTO_SERVICE", "tcp", None)]


def test_roll_up_equals_totals_of_the_log(spark, small):
    log = select_conn(fx.raw_log(spark, small))
    coarse = ["PROTO", "SERVICE", "PROTO_ORIG_H", "PROTO_SERVICE_ORIG_P"]
    fine = totals_all(log, ["PROTO_SERVICE_ORIG_H_P"])
    assert as_set(roll_up(fine, coarse)) == as_set(totals_all(log, coarse))


def test_unknown_or_no_type_is_refused(spark):
    with pytest.raises(ValueError, match="NOPE"):
        totals_all(conn_rows(spark, {}), ["NOPE"])
    with pytest.raises(ValueError):
        totals_all(conn_rows(spark, {}), [])


def test_run_tags_are_timestamps(spark):
    tagged = tag_run(totals(conn_rows(spark, {}), "PROTO"), "2024-01-01", datetime(2024, 2, 1))
    row = with_row_id(tagged).first()
    assert row["TS_FILTRO"] == datetime(2024, 1, 1)
    assert row["TS_CODE"] == datetime(2024, 2, 1)
    assert row["ROW_ID"] == 0


def test_run_time_does_not_depend_on_the_drivers_clock_zone(spark, monkeypatch):
    monkeypatch.setenv("TZ", "America/Sao_Paulo")
    time.tzset()
    try:
        rows = totals(conn_rows(spark, {}), "PROTO")
        tagged = tag_run(rows, "2024-01-01", datetime(2024, 2, 1, 12))
        row = tagged.selectExpr("string(TS_FILTRO)", "string(TS_CODE)").first()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert tuple(row) == ("2024-01-01 00:00:00", "2024-02-01 12:00:00")


def test_ties_of_the_busiest_are_in_order(spark):
    log = conn_rows(spark, *[{"ID_RESP_H": host} for host in "bacc"])
    rows = busiest_first(totals(log, "ORIG_H_RESP_H"), "ORIG_H_RESP_H").collect()
    assert [(r["ID_RESP_H"], r["COUNT"]) for r in rows] == [("c", 2), ("a", 1), ("b", 1)]


def test_clock_change_keeps_both_hours_apart(spark):
    """Formatting and parsing again would merge the two hours 23:xx of that night."""
    # 2019-02-17 00:00 went back to 23:00 in this zone: 01:30Z and 02:30Z are 23:30.
    log = spark.createDataFrame([(1550367000,), (1550370600,)], "s long").select(
        F.timestamp_seconds("s").alias("TS")
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        hours = log.select(
            F.date_trunc("hour", "TS").alias("h"), F.date_format("TS", "HH").alias("t")
        )
        assert hours.select("t").distinct().count() == 1
        assert hours.select("h").distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_exports_sort_by_time_and_not_by_its_text(spark):
    log = conn_rows(
        spark, {"TS": datetime(2024, 2, 1, 9)}, {"TS": datetime(2024, 1, 31, 9)}
    )
    export = with_text_time(totals_export(totals(log, "PROTO"), "PROTO"), "day")
    assert [r["TS"] for r in export.collect()] == ["31.01.2024", "01.02.2024"]


def test_export_text_is_read_back(spark):
    log = conn_rows(spark, {"TS": datetime(2024, 1, 31, 9, 41, 7)})
    for grain in BUCKET_FORMATS:
        rows = log.select(bucket(grain).alias("TS"), bucket_text(grain).alias("text"))
        row = rows.withColumn("back", bucket_from_text(grain, "text")).first()
        assert row["back"] == row["TS"], grain
    bad = log.select(bucket_from_text("hour", F.lit("31/01/2024 9h")).alias("ts"))
    assert bad.first()["ts"] is None
    with pytest.raises(ValueError, match="week"):
        bucket("week")


def test_twenty_types_have_an_export():
    assert len(TOTAL_TYPES) == 23
    assert len(EXPORTED) == 20


VALUES = st.fixed_dictionaries(
    {
        "PROTO": st.sampled_from(["tcp", "udp", None]),
        "SERVICE": st.sampled_from(["http", None]),
        "ID_ORIG_H": st.sampled_from(["a", "b"]),
        "ORIG_BYTES": st.one_of(st.none(), st.integers(0, 9)),
    }
)


@settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(VALUES, min_size=1, max_size=12))
def test_totals_against_plain_python(spark, rows):
    groups = {}
    for row in rows:
        key = (row["PROTO"], row["SERVICE"], row["ID_ORIG_H"])
        groups.setdefault(key, []).append(row["ORIG_BYTES"])
    expected = []
    for key, values in groups.items():
        known = [v for v in values if v is not None]
        expected.append((*key, len(values), sum(known) if known else None))
    found = totals_all(conn_rows(spark, *rows), ["PROTO_SERVICE_ORIG_H"])
    columns = ["PROTO", "SERVICE", "ID_ORIG_H", "COUNT", "ORIG_BYTES"]
    assert as_set(found, *columns) == sorted(expected, key=str)
