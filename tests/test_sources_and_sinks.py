from datetime import datetime

import pytest
from pyspark.sql import functions as F

from connlens import fixtures as fx
from connlens.operators.totals import tag_run, totals
from connlens.schemas import (
    CONN_SCHEMA,
    DDOS_SCHEMA,
    DNS_SCHEMA,
    HTTP_SCHEMA,
    RAW_SCHEMA,
    SCAN_SCHEMA,
    TOTALS_SCHEMA,
)
from connlens.session import materialize, scratch_folder
from connlens.sinks import (
    preview,
    read_results,
    write_csv,
    write_json,
    write_results,
)
from connlens.sources import records, tables
from logs import as_set, conn_rows

R1, R2 = datetime(2024, 2, 1), datetime(2024, 3, 1)


def test_schemas_have_the_documented_columns():
    lengths = [len(s) for s in (CONN_SCHEMA, DNS_SCHEMA, HTTP_SCHEMA)]
    assert lengths == [22, 23, 15]
    assert len(set(RAW_SCHEMA.names)) == len(RAW_SCHEMA)
    assert TOTALS_SCHEMA.names[-3:] == ["TS_FILTRO", "TS_CODE", "ROW_ID"]
    assert "ID_RESP_P" in DDOS_SCHEMA.names and "ID_RESP_P" not in SCAN_SCHEMA.names


def test_extracts_take_one_kind_and_its_columns(spark, small):
    raw = fx.raw_log(spark, small)
    assert raw.schema.names == RAW_SCHEMA.names
    for extract, schema, kind in (
        (records.conn_records, CONN_SCHEMA, "CONN"),
        (records.dns_records, DNS_SCHEMA, "DNS"),
        (records.http_records, HTTP_SCHEMA, "HTTP"),
    ):
        rows = extract(raw)
        assert rows.schema.names == schema.names
        assert as_set(rows.select("TIPO").distinct()) == [(kind,)]
    extra = records.dns_records(raw, extra=["ANSWERS", "TTLS"])
    assert extra.columns[-2:] == ["ANSWERS", "TTLS"]


def test_fixture_sizes(spark, small):
    for log, rows in ((fx.conn_log, 1000), (fx.dns_log, 199), (fx.http_log, 210)):
        assert log(spark, small).count() == rows


def test_filters_and_columns_reach_the_scan(spark, small, tmp_path):
    path = str(tmp_path / "LOG")
    fx.raw_log(spark, small).write.partitionBy("TIPO").parquet(path)
    raw = tables.read_table(spark, path)
    rows = totals(tables.select_conn(raw, "2024-01-01 00:20:00"), "PROTO")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "(TIPO" in scan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert "GreaterThan(TS,2024-01-01" in scan
    assert "ID_ORIG_H" not in scan.split("ReadSchema:")[1]


def test_since_is_exclusive_and_text_or_time(spark):
    log = conn_rows(spark, {"UID": "1", "TS": R1}, {"UID": "2", "TS": R2}, {"UID": "3"})
    for since in (R1, "2024-02-01 00:00:00"):
        assert as_set(tables.select_conn(log, since), "UID") == [("2",)]
    assert tables.select_conn(log).count() == 3


def test_results_are_rows_without_a_count(spark):
    log = conn_rows(spark, {}).withColumn("COUNT", F.lit(None).cast("bigint"))
    both = log.unionByName(log.withColumn("COUNT", F.lit(1).cast("bigint")))
    rows = tables.select_results(both, "2020-01-01", "CONN")
    assert as_set(rows, "COUNT") == [(None,)]
    assert tables.select_results(both, "2020-01-01", "DNS").isEmpty()


def test_totals_of_one_type_or_of_all(spark):
    log = conn_rows(spark, {})
    rows = tag_run(totals(log, "PROTO"), None, R1).unionByName(
        tag_run(totals(log, "ORIG_H"), None, R2), allowMissingColumns=True
    )
    assert tables.select_totals(rows, "2024-01-15").count() == 2
    assert as_set(tables.select_totals(rows, R1), "TIPO") == [("ORIG_H",)]
    assert tables.select_totals(rows, R1, "PROTO").isEmpty()
    assert tables.select_scores(rows, R1).count() == 1


def test_reading_by_name_path_and_options(spark, tmp_path):
    conn_rows(spark, {}).createOrReplaceTempView("some_log")
    assert tables.read_table(spark, "some_log", "table").count() == 1
    for source in ("parquet", "orc", "json"):
        path = str(tmp_path / source)
        conn_rows(spark, {}).write.format(source).save(path)
        rows = tables.read_table(spark, path, source, CONN_SCHEMA)
        assert as_set(rows) == as_set(conn_rows(spark, {}))


@pytest.mark.parametrize("write, source", [(write_csv, "csv"), (write_json, "json")])
def test_files_replace_what_is_there(spark, tmp_path, write, source):
    path = str(tmp_path / "out")
    write(conn_rows(spark, {}, {}), path)
    log = conn_rows(spark, {"SERVICE": None, "HISTORY": "Sh,\"a\"", "DURATION": None})
    write(log, path)
    rows = tables.read_table(spark, path, source, CONN_SCHEMA, header="true")
    assert as_set(rows) == as_set(log)


@pytest.mark.parametrize("write, source", [(write_csv, "csv"), (write_json, "json")])
def test_files_keep_microseconds(spark, tmp_path, write, source):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:07.179575' AS TS, 1 AS n")
    write(rows, str(tmp_path / "out"))
    back = tables.read_table(spark, str(tmp_path / "out"), source, rows.schema, header="true")
    assert as_set(back) == as_set(rows)


def test_a_run_written_again_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "T")

    def write(run, *rows):
        write_results(
            tag_run(totals(conn_rows(spark, *rows), "PROTO"), None, run), path, run, ["TIPO"]
        )

    write(R1, {}, {}, {"PROTO": "udp"})
    write(R2, {}, {}, {})
    write(R2, {})
    with pytest.raises(ValueError, match="overlap"):
        read_results(spark, path)
    assert as_set(read_results(spark, path, all_runs=True), "PROTO", "COUNT") == [
        ("tcp", 1),
        ("tcp", 2),
        ("udp", 1),
    ]
    assert as_set(read_results(spark, path, run_ts=R2), "PROTO", "COUNT") == [("tcp", 1)]
    newest = read_results(spark, path, ["TIPO", "TS", "PROTO"])
    assert as_set(newest, "PROTO", "COUNT") == [("tcp", 1), ("udp", 1)]
    late = read_results(spark, path, since=R2, all_runs=True)
    assert as_set(late, "PROTO", "COUNT") == [("tcp", 1)]
    # Fewer types than before: the run's earlier ones go.
    rows = totals(conn_rows(spark, {}), "SERVICE")
    write_results(tag_run(rows, None, R2), path, R2, ["TIPO"])
    assert as_set(read_results(spark, path, run_ts=R2), "TIPO") == [("SERVICE",)]
    write_results(tag_run(totals(conn_rows(spark, {}), "PROTO"), None, R2), path, R2, ["TIPO"], add=True)
    assert as_set(read_results(spark, path, run_ts=R2), "TIPO") == [("PROTO",), ("SERVICE",)]


def test_versions_of_a_key_are_thinned_out_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "T")
    rows = totals(conn_rows(spark, {}), "PROTO")
    write_results(tag_run(rows, None, R1), path, R1, ["TIPO"])
    newest = read_results(spark, path, ["TIPO", "TS", "PROTO"])
    plan = newest._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_null_keys_are_one_key(spark, tmp_path):
    path = str(tmp_path / "T")
    for run in (R1, R2):
        rows = totals(conn_rows(spark, {"SERVICE": None}), "SERVICE")
        write_results(tag_run(rows, None, run), path, run)
    assert read_results(spark, path, ["TS", "SERVICE"]).count() == 1


def test_row_ids_are_unique_in_a_run_and_type(spark, small, tmp_path):
    path = str(tmp_path / "T")
    rows = totals(fx.conn_log(spark, small), "ORIG_H_RESP_H")
    write_results(tag_run(rows, None, R1), path, R1, ["TIPO"])
    stored = read_results(spark, path, run_ts=R1)
    assert stored.select("ROW_ID").distinct().count() == stored.count() > 0


def test_an_empty_run_replaces_its_earlier_rows(spark, tmp_path):
    path = str(tmp_path / "T")
    rows = tag_run(totals(conn_rows(spark, {}), "PROTO"), None, R1)
    write_results(rows, path, R1, ["TIPO"])
    write_results(rows, path, R2, ["TIPO"])
    write_results(rows.limit(0), path, R1, ["TIPO"])
    assert read_results(spark, path, run_ts=R1).isEmpty()
    assert read_results(spark, path, run_ts=R2).count() == 1


class FakeSession:
    """A session with the given settings, on the given master."""

    def __init__(self, master, folder=None, checkpoint_dir=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self.checkpoint_dir = master, checkpoint_dir

    def getCheckpointDir(self):
        return self.checkpoint_dir

    def setCheckpointDir(self, folder):
        self.checkpoint_dir = f"{folder}/checkpoints"


def test_scratch_folder_follows_the_session():
    on_cluster = FakeSession("spark://host:7077", "hdfs://shared/scratch/")
    first, second = scratch_folder(on_cluster), scratch_folder(on_cluster)
    assert first.startswith("hdfs://shared/scratch/connlens-") and first != second
    by_context = FakeSession("yarn", checkpoint_dir="hdfs://other")
    assert scratch_folder(by_context).startswith("hdfs://other/")


def test_scratch_folder_of_one_machine_is_for_local_sessions_only():
    local = FakeSession("local[2]")
    assert scratch_folder(local).startswith(local.checkpoint_dir)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(FakeSession("yarn"))


def test_materialized_frames_keep_rows_and_types(spark):
    frame = conn_rows(spark, {}, {"SERVICE": None})
    stored = materialize(frame)
    assert as_set(stored) == as_set(frame)
    assert stored.dtypes == frame.dtypes


def test_preview_prints_count_schema_and_rows(spark, capsys):
    preview(conn_rows(spark, {"UID": "C7"}), "CONN")
    shown = capsys.readouterr().out
    assert "CONN: 1 rows" in shown and "ID_ORIG_H: string" in shown and "C7" in shown
