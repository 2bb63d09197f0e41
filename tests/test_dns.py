from pyspark.sql import functions as F

from connlens import fixtures as fx
from connlens.operators.dns import by_orig_bytes, conn_by_dns_query, conn_www_sum, dns_www
from connlens.schemas import DNS_SCHEMA
from connlens.sources.records import conn_records, dns_records
from connlens.sources.tables import read_table
from logs import as_set, conn_rows


def dns_rows(spark, *uids_and_names):
    data = [
        tuple({"UID": uid, "QUERY": name}.get(c) for c in DNS_SCHEMA.names)
        for uid, name in uids_and_names
    ]
    return spark.createDataFrame(data, DNS_SCHEMA)


def test_dot_of_www_is_taken_literally(spark):
    log = dns_rows(spark, ("1", "www.a"), ("2", "wwwxa"), ("3", "b.www.c"), ("4", None))
    assert [r["QUERY"] for r in dns_www(log).collect()] == ["b.www.c", "www.a"]


def test_repeated_lookups_and_connections_count_once(spark):
    lookups = dns_rows(spark, ("1", "www.a"), ("1", "www.a"), ("1", "www.b"))
    conn = conn_rows(spark, {"UID": "1"}, {"UID": "1"}, {"UID": "2"})
    joined = conn_by_dns_query(conn, lookups)
    assert as_set(joined, "UID", "QUERY") == [("1", "www.a"), ("1", "www.b")]


def test_sums_by_name_and_their_order(spark):
    lookups = dns_rows(spark, ("1", "www.a"), ("2", "www.a"), ("3", "www.b"))
    conn = conn_rows(
        spark,
        {"UID": "1", "RESP_BYTES": 5},
        {"UID": "2", "RESP_BYTES": None},
        {"UID": "3", "RESP_BYTES": 9},
    )
    rows = conn_www_sum(conn_by_dns_query(conn, lookups)).collect()
    assert [(r["QUERY"], r["RESP_BYTES"]) for r in rows] == [("www.b", 9), ("www.a", 5)]


def test_largest_senders_first(spark):
    conn = conn_rows(
        spark,
        {"UID": "1", "ORIG_BYTES": None},
        {"UID": "3", "ORIG_BYTES": 7},
        {"UID": "2", "ORIG_BYTES": 7},
    )
    assert [r["UID"] for r in by_orig_bytes(conn).collect()] == ["2", "3", "1"]


def test_hot_uid_is_split_and_nothing_is_lost(spark):
    """A third of the connections under one UID, with small split limits."""
    log = spark.range(0, 60_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("UID"),
        F.col("id").alias("n"),
    )
    first = conn_rows(spark, {}).drop("UID", "ORIG_BYTES")
    row = first.first().asDict()
    conn = log.select(
        "UID",
        F.col("n").alias("ORIG_BYTES"),
        *[F.lit(row[c]).cast(first.schema[c].dataType).alias(c) for c in first.columns],
    )
    lookups = log.where("n % 5 = 0").select("UID", F.lit("www.a").alias("QUERY"))
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        joined = conn_by_dns_query(conn, lookups)
        hot = [r for r in joined.collect() if r["UID"] == "hot"]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(hot) == 20_000
    assert "skew=true" in plan


def test_log_bucketed_by_uid_is_joined_without_an_exchange(spark, small, tmp_path):
    log = fx.raw_log(spark, small)
    writer = log.write.bucketBy(4, "UID").option("path", str(tmp_path / "LOG"))
    writer.saveAsTable("bucketed_log")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = read_table(spark, "bucketed_log", "table")
        joined = conn_by_dns_query(conn_records(raw), dns_www(dns_records(raw)))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        expected = conn_by_dns_query(conn_records(log), dns_www(dns_records(log)))
        assert as_set(joined) == as_set(expected)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE bucketed_log")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_each_lookup_finds_its_connection(spark, small):
    lookups = dns_www(fx.dns_log(spark, small))
    joined = conn_by_dns_query(fx.conn_log(spark, small), lookups)
    assert joined.count() == lookups.count()
