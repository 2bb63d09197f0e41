from datetime import datetime

import pytest

from connlens.sinks import compact_results, read_results, vacuum_results, write_results
from connlens.sinks.compaction import CompactionConflict, Manifest, _publish, read_manifest, stored_runs
from logs import as_set

RUNS = [datetime(2024, 1, day) for day in range(1, 7)]
KEYS = ["K", "L"]


def write(spark, path, run_ts, *rows, **options):
    table = spark.createDataFrame([(*r, run_ts) for r in rows], "K string, L int, N int, TS_CODE timestamp")
    write_results(table, path, run_ts, **options)


def current(spark, path, **options):
    return as_set(read_results(spark, path, KEYS, **options), *KEYS, "N")


def test_base_and_later_runs_equal_all_runs(spark, tmp_path):
    path = str(tmp_path / "T")
    write(spark, path, RUNS[0], ("a", 1, 1), ("b", None, 1), (None, None, 1))
    write(spark, path, RUNS[1], ("b", None, 2), ("c", 1, 2))
    expected = [("a", 1, 1), ("b", None, 2), ("c", 1, 2), (None, None, 1)]
    assert current(spark, path) == as_sorted(expected)
    first = compact_results(spark, path, KEYS)
    assert len(first.runs) == 2 and current(spark, path) == as_sorted(expected)
    # Nulls in a key are equal, across base and run too.
    write(spark, path, RUNS[2], (None, None, 3), ("a", 1, 3), ("d", 4, 3))
    expected = [("a", 1, 3), ("b", None, 2), ("c", 1, 2), ("d", 4, 3), (None, None, 3)]
    assert current(spark, path) == as_sorted(expected)
    assert compact_results(spark, path, KEYS).number == 2
    assert current(spark, path) == as_sorted(expected)
    removed = vacuum_results(spark, path)
    assert len(removed) == 5 and stored_runs(spark, path) == []
    assert current(spark, path) == as_sorted(expected)
    assert current(spark, path, since=RUNS[1]) == as_sorted([r for r in expected if r[2] >= 2])
    # Nothing new: the base stays.
    assert compact_results(spark, path, KEYS).number == 2


def as_sorted(rows):
    return sorted(rows, key=str)


def test_plan_ranks_the_new_runs_only(spark, tmp_path):
    path = str(tmp_path / "T")
    for run in RUNS[:2]:
        write(spark, path, run, ("a", 1, 1))
    compact_results(spark, path, KEYS)
    plan = read_results(spark, path, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    write(spark, path, RUNS[2], ("b", 1, 1))
    plan = read_results(spark, path, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    # Below the window there is one relation, the table of runs, cut to the new one.
    window = plan[plan.index("Window") :]
    assert "run-20240103" in window and "run-20240101" not in window


def test_a_reader_sees_one_state(spark, tmp_path):
    path = str(tmp_path / "T")
    write(spark, path, RUNS[0], ("a", 1, 1))
    write(spark, path, RUNS[1], ("a", 1, 2))
    before = read_results(spark, path, KEYS)
    compact_results(spark, path, KEYS)
    begun = read_results(spark, path, KEYS)
    write(spark, path, RUNS[2], ("a", 1, 3), ("z", 1, 3))
    # Planned before the switch, and before the run: what was there then.
    assert as_set(before, "K", "N") == [("a", 2)]
    assert as_set(begun, "K", "N") == [("a", 2)]
    assert current(spark, path) == [("a", 1, 3), ("z", 1, 3)]


def test_merged_runs_are_closed(spark, tmp_path):
    path = str(tmp_path / "T")
    write(spark, path, RUNS[1], ("a", 1, 1))
    write(spark, path, RUNS[1], ("a", 1, 2))
    compact_results(spark, path, KEYS)
    for run in RUNS[:2]:
        with pytest.raises(ValueError, match="not later"):
            write(spark, path, run, ("a", 1, 9))
    write(spark, path, RUNS[2], ("a", 1, 3))
    assert current(spark, path) == [("a", 1, 3)]


def test_two_compactions_at_once(spark, tmp_path):
    path = str(tmp_path / "T")
    write(spark, path, RUNS[0], ("a", 1, 1))
    own = compact_results(spark, path, KEYS)
    with pytest.raises(CompactionConflict):
        _publish(spark, path, Manifest(1, "base-other", (), tuple(KEYS)))
    assert read_manifest(spark, path) == own
    with pytest.raises(ValueError, match="keys"):
        compact_results(spark, path, ["K"])


def test_partitions_of_the_base(spark, tmp_path):
    path = str(tmp_path / "T")
    for run, n in ((RUNS[0], 1), (RUNS[1], 2)):
        write(spark, path, run, ("a", 1, n), ("b", n, n), by=["K"])
    compact_results(spark, path, KEYS, by=["K"])
    vacuum_results(spark, path)
    rows = read_results(spark, path, KEYS).where("K = 'b'")
    assert "PartitionFilters: [isnotnull(K" in rows._jdf.queryExecution().executedPlan().toString()
    assert as_set(rows, "L", "N") == [(1, 1), (2, 2)]
    assert vacuum_results(spark, str(tmp_path / "none")) == []
