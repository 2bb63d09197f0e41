"""Hard negatives and whitening against brute force, and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from connlens.llm import mining, queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int, score bigint, rank int, embedding_norm double, x string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3.0, "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Clustered vectors with nulls, bad entries, another length, repeated rows and ties."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(i, [float(np.float32(c)) for c in centres[i % 6] + 0.05 * rng.normal(size=5)], int(i % 4)) for i in range(0, 700, 2)]
    rows += [(100, rows[7][1], 2), (9, rows[0][1], 1), (11, rows[0][1], 1), rows[3], rows[3], (None, rows[0][1], 0), (None, rows[0][1], 1)]
    rows += [(1001, None, 1), (1003, [1.0, None, 1.0, 1.0, 1.0], 1), (1005, [math.nan] * 5, 1), (1007, [math.inf] * 5, 1), (1009, [], 1)]
    return rows + [(1011, [1.0] * 4, 1), (1013, [1.0] * 5, None), (1400, [0.0] * 5, 3)]


def clean(rows):
    return [r for r in rows if r[1] and len(r[1]) == 5 and all(c is not None and math.isfinite(c) for c in r[1])]


def mined(rows):
    kept = []
    for vec_id, vector, label in clean(rows):
        if label is not None:
            label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
            kept.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in vector], label))
    out = []

    def order(r):
        return (-r[0], r[1] is None, r[1] or 0)

    for a, x, label in kept:
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), b, other) for b, y, other in kept if b != a]
        for p, b, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            near = sorted((s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p), key=order)[:5]
            out += [(a, b, i + 1, c, p, n) for i, (n, c, _) in enumerate(near)]
    return out


def listed(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def test_hard_negatives_equal_brute_force(spark, odd, monkeypatch):
    expected = mined(odd)
    assert len(expected) > 50
    for block in (3, mining.BLOCK):
        monkeypatch.setattr(mining, "BLOCK", block)
        found = [tuple(r) for r in mining.hard_negatives(table(spark, odd).repartition(5)).collect()]
        assert listed(found) == listed(expected)


def test_tables_without_anchors_or_rows_give_nothing(spark, odd):
    for rows in ([], [r for r in odd if r[0] is None or r[0] % 100], [(100, None, 1)], [(100, [1.0], None)]):
        found = mining.hard_negatives(table(spark, rows))
        assert found.count() == 0
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_save_products_and_lose_none():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 300
    x = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 4)
    ids, labels = np.arange(3000), rng.integers(0, 3, 3000)
    pick = np.arange(0, 3000, 20)
    order, parent, edge = mining.spanning_tree(x[pick])
    pick = pick[order]
    block = mining.Block(ids[pick], labels[pick], x[pick], parent, edge)

    def chunks():
        return (mining.Chunk(ids[a : a + 500], labels[a : a + 500], x[a : a + 500]) for a in range(0, 3000, 500))

    best, count = mining.find_positives(block, chunks(), 5)
    assert count < 0.2 * len(pick) * len(x)
    for j, a in enumerate(pick):
        own = [(-int(x[b] @ x[a]), b) for b in ids if b != a and labels[b] == labels[a]]
        assert list(zip(-best.score[j], best.vec_id[j])) == sorted(own)[:5]


def test_spanning_tree_is_the_least():
    rng = np.random.default_rng(6)
    points = rng.integers(-50, 50, (40, 3)).astype(float)
    order, parent, edge = mining.spanning_tree(points)
    assert sorted(order) == list(range(40)) and all(parent[1:] < np.arange(1, 40))
    pairs = sorted((np.sqrt(((points[i] - points[j]) ** 2).sum()), i, j) for i in range(40) for j in range(i))
    group, total = list(range(40)), 0.0
    for length, i, j in pairs:
        if group[i] != group[j]:
            total += length
            group = [group[i] if g == group[j] else g for g in group]
    assert edge.sum() == pytest.approx(total)
    assert mining.spanning_tree(points[:1])[1].tolist() == [-1]


def test_scores_beyond_doubles_stay_exact():
    x, a = np.array([[2.0**40, 1.0]]), np.array([2.0**20, 3.0])
    assert mining.scores(x, a).tolist() == [2**60 + 3]
    assert mining.scores(x * 2.0**10, a).tolist() == [2**63 - 1]


def matrix(rows):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r[1]] for r in clean(rows)]
    return np.array(x), [r[0] for r in clean(rows)]


def check_whitening(found, x, ids, components=8):
    n, size = x.shape
    k = min(components, size)
    assert len(found) == n * k
    sums = [sum(int(v) for v in column) for column in x.T]
    deviation = sorted(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x)
    assert sorted(found[found.component == 1].deviation) == deviation
    assert set(found.n) == {n}
    centred = (n * x.astype(object) - np.array(sums, dtype=object)).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    for i in range(k):
        e, own = values[-1 - i], centred @ vectors[:, -1 - i] / np.sqrt(values[-1 - i])
        part = found[found.component == i + 1]
        assert np.allclose(part.explained, e / values.sum(), rtol=1e-9)
        # Rows are told apart by their sums of squares and numbers, the sign is free.
        got, expected = part.whitened.to_numpy(), own
        errors = [np.abs(np.sort(sign * got) - np.sort(expected)).max() for sign in (1, -1)]
        assert min(errors) < 1e-7
        by_id = dict(zip(part.vec_id, got))
        truth = dict(zip(ids, expected * (1 if errors[0] < errors[1] else -1)))
        unique = [i for i in truth if i is not None and ids.count(i) == 1]
        assert all(abs(by_id[i] - truth[i]) < 1e-7 for i in unique)
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9


def test_whitening_equals_a_plain_eigendecomposition(spark, odd):
    x, ids = matrix(odd)
    check_whitening(whitening.whitened(table(spark, odd).repartition(11)).toPandas(), x, ids)


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r[1]] for r in rows])
    check_whitening(queries.op12_whitening(spark, SF).toPandas(), x, [r[0] for r in rows])


def test_whitening_of_few_or_equal_rows(spark, odd):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    for rows in ([(1, [1.0, 2.0], 1)], [(i, [1.0, 2.0], 1) for i in range(5)]):
        found = whitening.whitened(table(spark, rows)).toPandas()
        assert len(found) == 2 * len(rows) and found.whitened.isna().all() and found.identity_error.isna().all()
        assert set(found.deviation) == {0}
    # One component has variance, the other none.
    found = whitening.whitened(table(spark, [(i, [float(i), 2.0], 1) for i in range(4)])).toPandas()
    assert found[found.component == 1].whitened.abs().round(6).tolist() == [1.341641, 0.447214, 0.447214, 1.341641]
    assert found[found.component == 2].whitened.isna().all() and found.identity_error.max() < 1e-12


def test_sums_too_large_for_a_long_are_null(spark):
    found = whitening.whitened(table(spark, [(i, [float(i) * 1e9, 1.0], 1) for i in range(4)])).toPandas()
    assert found.deviation.isna().all() and found.whitened.notna().any()


def test_updates_of_a_spectrum():
    rng = np.random.default_rng(1)
    for trial in range(120):
        k = rng.integers(1, 30)
        d = np.sort(rng.integers(0, 5, k).astype(float) * rng.choice([1, 1e-9, 1e6])) if trial % 2 else np.sort(rng.random(k))
        q = np.linalg.qr(rng.normal(size=(k, k)))[0]
        z = rng.normal(size=k) * rng.choice([1, 1e-8, 1e5])
        if trial % 3 == 0:
            z[rng.random(k) < 0.5] = 0
        whole = q @ (np.diag(d) + np.outer(z, z)) @ q.T
        values, vectors = whitening.rank_one(d, q, z)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(vectors @ np.diag(values) @ vectors.T - whole).max() <= 1e-12 * max(np.abs(whole).max(), 1e-300)


def test_spectra_are_combined():
    rng = np.random.default_rng(2)
    x = rng.integers(-1000, 1000, (300, 6)) @ rng.integers(-3, 4, (6, 6)) + 100_000
    for block in (1, 50):
        parts = [whitening.Spectrum.empty(6) for _ in range(3)]
        for part, rows in zip(parts, (x[:100], x[100:101], x[101:])):
            part.add(rows, block)
        whole = whitening.Spectrum.empty(6)
        for part in [whitening.Spectrum.empty(6), *parts]:
            whole.merge(part)
        apart = x - x.mean(axis=0)
        scatter = apart.T @ apart
        assert whole.n == 300 and whole.sums.tolist() == x.sum(axis=0).tolist()
        assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - scatter).max() < 1e-11 * np.abs(scatter).max()


def test_one_path_of_the_tree_holds_a_chunk_of_bounds(spark):
    """A batch is cut into chunks, whatever the size of its vectors."""
    rows = table(spark, [(i, [float(i % 7)] * 40, i % 3) for i in range(0, 4000)])
    assert rows.where(F.size("embedding") == 40).count() == 4000
    sizes = []
    prepared = mining.prepared(rows).toArrow().combine_chunks().to_batches()
    for chunk in mining.chunks(iter(prepared)):
        sizes.append(chunk.x.size)
    assert sum(sizes) == 160_000 and max(sizes) <= mining.CHUNK
