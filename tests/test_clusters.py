import itertools
from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from connlens import fixtures as fx
from connlens.operators import clusters, lloyd
from connlens.operators.exports import with_text_centres
from connlens.operators.features import ddos_features, scan_features
from connlens.sinks import has_model, load_model, save_model
from logs import as_set, conn_rows


def counts(spark, *values, kind="http"):
    return spark.createDataFrame(
        [(kind, f"a{i}", f"v{i}", c) for i, c in enumerate(values)],
        "SERVICE string, ID_ORIG_H string, ID_RESP_H string, COUNT bigint",
    )


def test_scan_counts_source_ports_and_not_target_ports(spark):
    log = conn_rows(
        spark,
        {"ID_RESP_P": 1},
        {"ID_RESP_P": 2},
        {"ID_ORIG_P": 41000, "ID_RESP_P": 1},
        {"PROTO": "udp"},
    )
    rows = as_set(scan_features(log, ["tcp"]), "ID_ORIG_P", "COUNT")
    assert rows == [(40000, 2), (41000, 1)]


def test_features_of_several_services_equal_single_ones(spark, small):
    log = fx.conn_log(spark, small)
    both = ddos_features(log, ["http", "ssh"])
    single = ddos_features(log, ["http"]).unionByName(ddos_features(log, ["ssh"]))
    assert as_set(both) == as_set(single)


def best_cut(values):
    """Brute force: the mean of both parts of the best split, the lowest of equally good ones."""
    values = sorted(values)
    options = []
    for i in range(1, len(values)):
        if values[i - 1] < values[i]:
            parts = [[Fraction(v) for v in part] for part in (values[:i], values[i:])]
            error = sum(sum((v - sum(p) / len(p)) ** 2 for v in p) for p in parts)
            options.append((error, values[i - 1], [float(sum(p) / len(p)) for p in parts]))
    return min(options)[2] if options else [float(values[0])]


def test_training_equals_k_means_on_all_rows(spark):
    rows = counts(spark, *[1] * 50, *[2] * 7, *[30] * 5)
    every = KMeans(k=2, seed=5).fit(clusters.with_vector(rows, ["COUNT"]))
    assert clusters.train(rows) == pytest.approx(clusters.centres_of(every))


def test_cuts_of_random_histograms_are_the_best(spark):
    rng = np.random.default_rng(9)
    kinds = {f"k{i}": rng.integers(1, 3 + i, rng.integers(1, 40)).tolist() for i in range(25)}
    # Mirrored and evenly spread counts: equally good cuts.
    kinds |= {"mirror": [1, 2, 3], "even": list(range(1, 9)), "pairs": [1, 1, 5, 5, 9, 9], "one": [7, 7]}
    kinds["large"] = [1, 10**9, 10**9 + 1]
    rows = [(k, c) for k, values in kinds.items() for c in values] + [("one", None)]
    table = spark.createDataFrame(rows, "SERVICE string, COUNT bigint")
    found = clusters.train_kinds(table, "SERVICE", list(kinds))
    for kind, values in kinds.items():
        assert found[kind] == pytest.approx(best_cut(values), rel=1e-14), kind
    parts = {r["SERVICE"]: r for r in clusters.best_cuts(clusters.histogram(table, "SERVICE"), "SERVICE").collect()}
    assert parts["one"]["CUT"] is None and parts["one"]["UPPER"] is None and parts["one"]["LOWER"]["ROWS"] == 2
    assert parts["even"]["CUT"] == 4 and parts["even"]["LOWER"]["WSSSE"] == 5.0
    assert parts["large"]["CUT"] == 1 and parts["large"]["UPPER"]["WSSSE"] == 0.5


def test_all_kinds_take_one_aggregation(spark):
    rows = counts(spark, 1, 9)
    cuts = clusters.best_cuts(clusters.histogram(rows, "SERVICE"), "SERVICE")
    plan = cuts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_labels_follow_the_centres_and_not_the_fit(spark):
    class Reversed:
        def clusterCenters(self):
            return [np.array([30.0]), np.array([1.0])]

    centres = clusters.centres_of(Reversed())
    assert centres == [1.0, 30.0]
    scored = clusters.score(counts(spark, 1, 40), centres)
    rows = as_set(scored, "COUNT", "PREDICTION", "CENTRE", "CENTROID")
    assert rows == [(1, 0, 1.0, centres), (40, 1, 30.0, centres)]


def test_scoring_equals_the_model_itself(spark):
    rows = counts(spark, 1, 2, 3, 9, 14, 16, 30, 31, 100)
    model = KMeans(k=2, seed=1).fit(clusters.with_vector(rows, ["COUNT"]))
    centres = clusters.centres_of(model)
    assert clusters.train(rows) == pytest.approx(centres)
    rank = [centres.index(float(c[0])) for c in model.clusterCenters()]
    fitted = model.transform(clusters.with_vector(rows, ["COUNT"]))
    expected = sorted((r["COUNT"], rank[r["prediction"]]) for r in fitted.collect())
    found = clusters.score(rows, centres).select("COUNT", "PREDICTION").collect()
    assert sorted(map(tuple, found)) == expected


def test_each_kind_gets_the_model_of_its_rows(spark):
    rows = counts(spark, 1, 1, 9).unionByName(counts(spark, 2, 50, 52, kind="ssh"))
    centres = clusters.train_kinds(rows, "SERVICE", ["http", "ssh", "gopher"])
    assert centres == {"http": [1.0, 9.0], "ssh": [2.0, 51.0]}
    assert clusters.train_kinds(rows, "SERVICE", ["gopher"]) == {}


def test_centres_as_text(spark):
    scored = with_text_centres(clusters.score(counts(spark, 1), [1.5, 30.0]))
    assert scored.first()["CENTROID"] == ["1.5", "30.0"]


def test_more_than_two_centres(spark):
    scored = clusters.score(counts(spark, 1, 6, 11, 99), [1.0, 10.0, 100.0])
    assert as_set(scored, "COUNT", "PREDICTION") == [(1, 0), (11, 1), (6, 1), (99, 2)]


def test_one_distinct_count_is_no_attack(spark):
    rows = counts(spark, 4, 4, 4)
    centres = clusters.train(rows)
    assert centres == [4.0]
    scored = clusters.score(rows, centres)
    assert as_set(scored.select("PREDICTION").distinct()) == [(0,)]
    assert clusters.attackers(scored, "SERVICE").isEmpty()


def test_two_clusters_split_harmless_data_unless_told_otherwise(spark):
    rows = counts(spark, 1, 1, 1, 2)
    centres = clusters.train(rows)
    found = clusters.attackers(clusters.score(rows, centres), "SERVICE")
    assert as_set(found) == [("http", "a3")]
    quiet = clusters.score(rows, centres, min_count=5)
    assert clusters.attackers(quiet, "SERVICE").isEmpty()


def test_each_kind_is_scored_with_its_own_centres(spark):
    rows = counts(spark, 5, 50).unionByName(counts(spark, 5, 50, kind="ssh"))
    rows = rows.unionByName(counts(spark, 5, kind="dns"))
    centres = {"http": [1.0, 50.0], "ssh": [1.0, 5.0]}
    scored = clusters.score_kinds(rows, "SERVICE", centres)
    assert as_set(scored, "SERVICE", "COUNT", "PREDICTION") == [
        ("http", 5, 0),
        ("http", 50, 1),
        ("ssh", 5, 1),
        ("ssh", 50, 1),
    ]
    http = scored.where("SERVICE = 'http'")
    alone = clusters.score(rows.where("SERVICE = 'http'"), centres["http"])
    assert as_set(http, *alone.columns) == as_set(alone)


def test_error_sum_and_sizes(spark):
    scored = clusters.score(counts(spark, 1, 3, 10), [2.0, 10.0])
    assert clusters.wssse(scored).first()["WSSSE"] == 2.0
    sizes = as_set(clusters.centre_sizes(scored), "PREDICTION", "CENTRE", "ROWS")
    assert sizes == [(0, 2.0, 2), (1, 10.0, 1)]


def test_silhouette_by_hand(spark):
    scored = clusters.score(counts(spark, 1, 2, 10), [1.5, 10.0])
    # Squared distances: 1 and 81, 1 and 64; a single row counts as 0.
    found = clusters.silhouette(scored, "SERVICE").first()
    assert found["KIND"] == "http" and found["SILHOUETTE"] == pytest.approx((80 / 81 + 63 / 64 + 0) / 3)


def test_silhouette_equals_pairwise_distances(spark):
    rng = np.random.default_rng(4)
    rows = [("http", int(c), int(p)) for c, p in zip(rng.integers(1, 9, 60), rng.integers(0, 3, 60))]
    rows += [("ssh", int(c), int(c > 4)) for c in rng.integers(1, 9, 40)] + [("dns", 3, 0), ("dns", 3, 0), ("ssh", None, 0)]
    table = spark.createDataFrame(rows, "SERVICE string, COUNT bigint, PREDICTION int")

    def by_pairs(kind):
        own = [(c, p) for k, c, p in rows if k == kind and c is not None]
        values = []
        for i, (c, p) in enumerate(own):
            inside = [(c - d) ** 2 for j, (d, q) in enumerate(own) if q == p and j != i]
            outside = [np.mean([(c - d) ** 2 for d, r in own if r == q]) for q in {q for _, q in own} - {p}]
            if not outside:
                return None
            a, b = np.mean(inside) if inside else 0.0, min(outside)
            values.append((b - a) / max(a, b) if inside and max(a, b) else 0.0)
        return np.mean(values)

    found = {r["KIND"]: r["SILHOUETTE"] for r in clusters.silhouette(table, "SERVICE").collect()}
    assert found.pop("dns") is None and by_pairs("dns") is None
    assert found == {kind: pytest.approx(by_pairs(kind)) for kind in ("http", "ssh")}


def test_silhouette_equals_spark(spark):
    scored = clusters.score(counts(spark, 1, 1, 2, 3, 8, 9, 30), [2.0, 15.0])
    points = clusters.with_vector(scored.select("COUNT", "PREDICTION"), ["COUNT"])
    expected = ClusteringEvaluator(predictionCol="PREDICTION").evaluate(points)
    assert clusters.silhouette(scored, "SERVICE").first()["SILHOUETTE"] == pytest.approx(expected)


def test_victims_and_their_whole_history(spark):
    rows = spark.createDataFrame(
        [
            ("http", "a", "v", 1, 50),
            ("http", "b", "v", 0, 1),
            ("http", "b", "w", 0, 1),
            ("ssh", "c", "v", 0, 1),
        ],
        "SERVICE string, ID_ORIG_H string, ID_RESP_H string, PREDICTION int, COUNT bigint",
    )
    assert as_set(clusters.attackers(rows, "SERVICE")) == [("http", "a")]
    assert as_set(clusters.victims(rows, "SERVICE")) == [("http", "v")]
    for limit in (0, 1000):
        history = clusters.victim_history(rows, "SERVICE", broadcast_bytes=limit)
        assert history.columns == rows.columns
        assert as_set(history, "ID_ORIG_H", "COUNT") == [("a", 50), ("b", 1)]


MULTI = "DURATION double, ORIG_PKTS bigint, ORIG_BYTES bigint"
NAMES = ["DURATION", "ORIG_PKTS", "ORIG_BYTES"]


def test_three_features_against_brute_force(spark):
    points = [(0.0, 1, 10), (0.5, 2, 11), (1.0, 1, 12), (9.0, 40, 900), (8.0, 44, 910)]
    rows = spark.createDataFrame([*points, (None, 1, 1), (1.0, None, 1), (1.0, 1, None)], MULTI)
    usable = lloyd.usable(rows, NAMES)
    fit = lloyd.lloyd(usable, NAMES, lloyd.extremes(usable, NAMES))
    scored = lloyd.score_points(usable, fit).collect()
    assert len(scored) == len(points) and fit.rows == (3, 2)

    def error(labels):
        groups = [[p for p, l in zip(points, labels) if l == k] for k in (0, 1)]
        if not all(groups):
            return float("inf")
        return sum(((np.array(g) - np.mean(g, axis=0)) ** 2).sum() for g in groups)

    best = min(error(labels) for labels in itertools.product((0, 1), repeat=len(points)))
    assert sum(r["SQ_ERROR"] for r in scored) == pytest.approx(best) == pytest.approx(fit.wssse)
    assert {r["ORIG_BYTES"]: r["PREDICTION"] for r in scored} == {10: 0, 11: 0, 12: 0, 900: 1, 910: 1}


def test_lloyd_equals_plain_iterations(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, (200, 3)).astype(float)
    starts = [tuple(c) for c in x[:4]]
    centres = np.array(starts)
    while True:
        apart = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        label = apart.argmin(axis=1)
        moved = np.array([x[label == i].mean(axis=0) if (label == i).any() else centres[i] for i in range(4)])
        if np.array_equal(moved, centres):
            break
        centres = moved
    table = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in x], MULTI).repartition(5)
    fit = lloyd.lloyd(table, NAMES, starts)
    order = sorted(range(4), key=lambda i: tuple(centres[i]))
    assert np.allclose(fit.centres, centres[order])
    assert list(fit.rows) == [int((label == i).sum()) for i in order]
    assert fit.wssse == pytest.approx(apart.min(axis=1).sum())
    table = lloyd.fit_table(table, fit)
    assert table.columns == ["PREDICTION", *NAMES, "ROWS", "WSSSE"] and table.count() == 4


def test_lloyd_on_few_rows(spark):
    none = spark.createDataFrame([], MULTI)
    assert lloyd.extremes(none, NAMES) == []
    assert lloyd.lloyd(none, NAMES, []).centres == ()
    same = spark.createDataFrame([(1.0, 2, 3)] * 4, MULTI)
    fit = lloyd.lloyd(same, NAMES, lloyd.extremes(same, NAMES))
    assert fit.centres == ((1.0, 2.0, 3.0),) and fit.rows == (4,) and fit.wssse == 0
    assert {r["PREDICTION"] for r in lloyd.score_points(same, fit).collect()} == {0}
    # Between both centres: the first. A centre without rows stays where it is.
    middle = spark.createDataFrame([(0.0, 0, 0), (2.0, 0, 0), (4.0, 0, 0)], MULTI)
    fit = lloyd.lloyd(middle, NAMES, [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (90.0, 0.0, 0.0)])
    assert fit.centres == ((1.0, 0.0, 0.0), (4.0, 0.0, 0.0), (90.0, 0.0, 0.0)) and fit.rows == (2, 1, 0)


def test_model_is_saved_replaced_and_loaded(spark, tmp_path):
    path = str(tmp_path / "http")
    assert not has_model(spark, path)
    # A model that Spark ML has saved is read as well, until it is trained anew.
    points = clusters.with_vector(counts(spark, 2, 2, 8), ["COUNT"])
    KMeans(k=2, seed=1).fit(points).write().save(path)
    assert has_model(spark, path) and load_model(spark, path) == [2.0, 8.0]
    for values in ([1, 9], [1, 5]):
        save_model(spark, clusters.train(counts(spark, *values)), path)
    assert has_model(spark, path)
    assert load_model(spark, path) == [1.0, 5.0]


def test_hosts_involved_are_hosts_of_the_features(spark, small):
    rows = ddos_features(fx.conn_log(spark, small), ["http"]).cache()
    scored = clusters.score(rows, clusters.train(rows))
    hosts = {r[0] for r in rows.select("ID_ORIG_H").collect()}
    found = clusters.attackers(scored, "SERVICE").select(F.col("ID_ORIG_H")).collect()
    assert found and {r[0] for r in found} <= hosts
    rows.unpersist()
