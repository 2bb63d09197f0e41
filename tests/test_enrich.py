from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from connlens import fixtures as fx
from connlens.functions import measured_bytes
from connlens.operators import enrich as en
from connlens.operators.totals import totals
from connlens.plans.enrichment import Lookups, process_ips
from connlens.schemas import IP_INFO_SCHEMA
from logs import as_set

RUN = datetime(2024, 1, 2, 15)
TODAY = datetime(2024, 1, 2)


def info_rows(spark, *rows):
    """IP_INFO rows out of (ip, hostname, taken at)."""
    data = [(ip, host, None, None, None, None, None, None, ts) for ip, host, ts in rows]
    return spark.createDataFrame(data, IP_INFO_SCHEMA)


def data_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "ID_ORIG_H string, COUNT bigint")


def test_known_and_missing_make_up_the_distinct_addresses(spark, small):
    info, log = fx.ip_info(spark, small), fx.conn_log(spark, small)
    known = {r["IP"] for r in en.ipinfo_known(info, log, "ID_ORIG_H").collect()}
    missing = {r[0] for r in en.ipinfo_missing(info, log, "ID_ORIG_H").collect()}
    every = {r[0] for r in en.distinct_ips(log, "ID_ORIG_H").collect()}
    assert known and missing
    assert known | missing == every and not known & missing


def test_an_address_stored_twice_does_not_multiply_rows(spark):
    info = info_rows(
        spark, ("a", "old", datetime(2024, 1, 1)), ("a", "new", datetime(2024, 1, 2))
    )
    data = data_rows(spark, ("a", 1), ("a", 2), ("b", 3), (None, 4))
    rows = as_set(en.enrich(data, info, "ID_ORIG_H"), "ID_ORIG_H", "COUNT", "HOSTNAME")
    assert rows == [("a", 1, "new"), ("a", 2, "new"), ("b", 3, None), (None, 4, None)]


def test_failed_lookups_of_the_past_are_not_matched(spark):
    info = info_rows(spark, (None, "nobody", TODAY))
    data = data_rows(spark, (None, 1))
    assert as_set(en.enrich(data, info, "ID_ORIG_H"), "HOSTNAME") == [(None,)]
    assert en.ipinfo_missing(info, data, "ID_ORIG_H").isEmpty()


@pytest.mark.parametrize("used, left", [(0, 1000), (999, 1), (1000, 0), (1001, 0)])
def test_quota_of_the_day(spark, used, left):
    info = spark.range(used + 1).select(
        F.when(F.col("id") == used, F.lit(TODAY)).otherwise(F.lit(RUN)).alias("TS_CODE")
    )
    assert en.lookup_quota(info, TODAY).first()["QUOTA"] == left


def test_candidates_are_the_busiest_missing_ones(spark):
    data = data_rows(spark, ("a", 1), ("b", 5), ("a", 5), ("c", 9), ("d", 5), (None, 99))
    info = info_rows(spark, ("c", "known", TODAY))
    found = en.lookup_candidates(info, data, "ID_ORIG_H", 2).collect()
    assert [tuple(r) for r in found] == [("a", 6), ("b", 5)]
    hosts = data.select("ID_ORIG_H")
    found = en.lookup_candidates(info, hosts, "ID_ORIG_H", 1).collect()
    assert [tuple(r) for r in found] == [("a", 2)]


def sample_provider():
    def ask(ip):
        if ip == "bad":
            raise RuntimeError("no answer")
        if ip == "unknown":
            return None
        return {"hostname": f"h-{ip}", "latitude": "1.5", "longitude": "east"}

    return ask


def test_lookup_tolerates_failures_and_bad_numbers(spark):
    asked = data_rows(spark, ("x", 1), ("bad", 1), ("unknown", 1))
    found = en.look_up(asked, "ID_ORIG_H", sample_provider(), RUN)
    assert found.schema.names == IP_INFO_SCHEMA.names
    assert [f.dataType for f in found.schema] == [f.dataType for f in IP_INFO_SCHEMA]
    assert as_set(found, "IP", "HOSTNAME", "LATITUDE", "LONGITUDE", "TS_CODE") == [
        ("bad", None, None, None, RUN),
        ("unknown", None, None, None, RUN),
        ("x", "h-x", 1.5, None, RUN),
    ]


def test_union_goes_by_name(spark):
    info = info_rows(spark, ("a", "h", TODAY))
    turned = info.select(*reversed(IP_INFO_SCHEMA.names)).drop("CITY")
    both = en.ipinfo_union(info, turned)
    assert as_set(both, "IP", "HOSTNAME") == [("a", "h"), ("a", "h")]


def test_pipeline_looks_up_stores_and_joins(spark, tmp_path):
    store = str(tmp_path / "IP_INFO")
    info_rows(spark, ("a", "known", datetime(2024, 1, 1))).write.parquet(store)
    data = data_rows(spark, ("a", 1), ("x", 7), ("y", 3), ("bad", 9), ("z", 1))

    def run(**more):
        info = spark.read.parquet(store)
        out = process_ips(data, info, "ID_ORIG_H", RUN, **more)
        return as_set(out, "ID_ORIG_H", "HOSTNAME")

    stored = [("a", "known"), ("bad", None), ("x", None), ("y", None), ("z", None)]
    assert run() == stored
    # The busiest three are asked; one of them fails.
    enriched = [("a", "known"), ("bad", None), ("x", "h-x"), ("y", "h-y"), ("z", None)]
    asked = run(lookups=Lookups(sample_provider(), store, limit=3))
    assert asked == enriched
    assert {r["IP"] for r in spark.read.parquet(store).collect()} == {"a", "bad", "x", "y"}
    assert run() == enriched
    # The one that failed is asked again only when told to.
    def missing(retry):
        info = spark.read.parquet(store)
        return as_set(en.ipinfo_missing(info, data, "ID_ORIG_H", retry))

    assert missing(None) == [("z",)]
    assert missing(RUN + timedelta(seconds=1)) == [("bad",), ("z",)]


def test_pipeline_stops_at_the_days_allowance(spark):
    info = info_rows(spark, ("a", "today", RUN))
    data = data_rows(spark, ("x", 2), ("y", 1))
    for per_day, hosts in ((1, [None, None]), (2, ["h-x", None]), (9, ["h-x", "h-y"])):
        out = process_ips(
            data, info, "ID_ORIG_H", RUN, Lookups(sample_provider(), limit=5, per_day=per_day)
        )
        assert [r[1] for r in as_set(out, "ID_ORIG_H", "HOSTNAME")] == hosts


@pytest.mark.parametrize("hot", ["hot", None])
def test_hot_or_absent_address_is_spread_and_every_row_kept(spark, hot):
    data = spark.range(0, 30_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, F.lit(hot))
        .otherwise(F.col("id").cast("string"))
        .alias("ID_ORIG_H"),
        F.col("id").alias("COUNT"),
    )
    info = info_rows(spark, ("hot", "h", TODAY), ("1", "one", TODAY), ("1", "old", None))
    salted = en.enrich(data, info, "ID_ORIG_H", broadcast_bytes=0)
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ID_ORIG_H" in plan and "_salt" in plan
    assert "Broadcast" not in plan
    assert as_set(salted) == as_set(en.enrich(data, info, "ID_ORIG_H"))
    found = {r["HOSTNAME"]: r["count"] for r in salted.groupBy("HOSTNAME").count().collect()}
    matched = {"h": 10_000} if hot else {}
    assert found == {"one": 1, None: 30_000 - 1 - sum(matched.values()), **matched}
    # The third of all rows with that address is in several tasks.
    where = salted.where(F.col("ID_ORIG_H").eqNullSafe(hot))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = where.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 5_000


def test_only_a_table_measured_small_is_broadcast(spark):
    info = info_rows(spark, ("a", "é" * 1000, TODAY))
    size = measured_bytes(en.newest_info(info).drop("TS_CODE"))
    assert 2000 < size < 2300
    data = data_rows(spark, ("a", 1))
    for limit, broadcast in ((size, True), (size - 40, False)):
        out = en.enrich(data, info, "ID_ORIG_H", broadcast_bytes=limit)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("_salt" not in plan) == broadcast
    assert measured_bytes(info.limit(0)) == 0


def test_enriching_totals_keeps_their_number(spark, small):
    rows = totals(fx.conn_log(spark, small), "PROTO_SERVICE_RESP_H")
    known = en.enrich(rows, fx.ip_info(spark, small), "ID_RESP_H")
    assert known.count() == rows.count()
    assert not {"IP", "TS_CODE"} & set(known.columns)
