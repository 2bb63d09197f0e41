import pytest

from connlens import fixtures as fx
from connlens.operators.lattice import (
    covers,
    levels,
    measured_sizes,
    roots,
    spanning_plan,
    totals_by_lattice,
)
from connlens.operators.totals import totals_all
from connlens.schemas import DEFAULT_TOTAL_TYPES, TOTAL_TYPES
from logs import as_set

ALL = list(TOTAL_TYPES)
ROOTS = ["PROTO_SERVICE_ORIG_H_P", "PROTO_SERVICE_RESP_H_P", "ORIG_H_P_RESP_H_P"]


def test_roots_are_covered_by_none():
    assert roots(ALL) == ROOTS
    assert roots(["PROTO", "SERVICE"]) == ["PROTO", "SERVICE"]


def test_plan_takes_the_smallest_parent():
    sizes = {t: 10 ** len(TOTAL_TYPES[t]) for t in ALL} | {"PROTO_ORIG_H": 50, "ORIG_H_RESP_H": 60}
    plan = spanning_plan(ALL, sizes, worth=1)
    assert set(plan) == set(ALL) - set(ROOTS)
    assert all(covers(parent, tipo) for tipo, parent in plan.items())
    assert plan["ORIG_H"] == "PROTO_ORIG_H" and plan["RESP_H"] == "ORIG_H_RESP_H"
    order = [t for step in levels(plan) for t in step]
    assert sorted(order) == sorted(plan)
    place = {t: i for i, step in enumerate(levels(plan)) for t in step}
    assert all(place.get(plan[t], -1) < place[t] for t in plan)
    # Where nothing is worth storing, all come from the roots.
    assert set(spanning_plan(ALL, sizes, worth=10**9).values()) <= set(ROOTS)


@pytest.mark.parametrize("worth", [1, 2_000_000])
def test_lattice_equals_copies(spark, small, worth):
    conn = fx.conn_log(spark, small)
    for tipos in (ALL, DEFAULT_TOTAL_TYPES, ["PROTO", "SERVICE"], ["ORIG_H"]):
        found, expected = totals_by_lattice(conn, tipos, worth), totals_all(conn, tipos)
        assert found.columns == expected.columns
        assert as_set(found) == as_set(expected)


def test_log_rows_are_copied_for_the_roots_only(spark, small, monkeypatch):
    from connlens.operators import lattice

    seen = []
    plain = lattice.totals_all
    monkeypatch.setattr(lattice, "totals_all", lambda conn, tipos: seen.append(list(tipos)) or plain(conn, tipos))
    rows = totals_by_lattice(fx.conn_log(spark, small), ALL)
    assert seen == [ROOTS]
    assert "events" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_sizes_are_counted_or_estimated(spark, small):
    conn = fx.conn_log(spark, small)
    tops = totals_all(conn, ROOTS).cache()
    sizes = measured_sizes(tops, ALL, ROOTS, worth=1)
    true = {r["TIPO"]: r["count"] for r in totals_all(conn, ALL).groupBy("TIPO").count().collect()}
    assert all(sizes[t] == true[t] for t in ROOTS)
    assert all(abs(sizes[t] - true[t]) <= max(2, 0.2 * true[t]) for t in ALL)
    assert set(measured_sizes(tops, ALL, ROOTS)) == set(ROOTS)
    tops.unpersist()
