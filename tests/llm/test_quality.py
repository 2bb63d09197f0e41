"""The quality classifier against held-out labels, and on odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from connlens.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    found = {r["doc_id"]: r for r in queries.op13_quality(spark, SF).collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(found[d], y) for d, y in labels if d in found and found[d]["held_out"]]
    good, bad = [r["score"] for r, y in held if y == 1], [r["score"] for r, y in held if y == 0]
    assert len(bad) > 10
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())


@pytest.fixture(scope="module")
def labelled(spark):
    good = [(i, f"a quiet text on matter {i % 7} with word{i % 13} and so on", 1) for i in range(200)]
    bad = [(i, f"$$$ buy%%% now&&& {'bla' * (i % 5 + 1)} {'bla' * (i % 5 + 1)}!!", 0) for i in range(200, 300)]
    rows = [*good, *bad, (300, None, 1), (301, "", 0), (302, " \n", 1), (None, "no number", 1), (303, "x" * 50, None)]
    docs = spark.createDataFrame([(i, t, 0.5, 1, "z") for i, t, _ in rows], "doc_id bigint, text string, score double, quality int, held_out string")
    marks = [(i, q) for i, _, q in rows] + [(5, 0), (7, 9), (999, 1)]
    return docs, spark.createDataFrame(marks, "doc_id bigint, quality int")


def test_odd_rows_and_clashing_columns(spark, labelled):
    docs, marks = labelled
    rows = quality.quality(docs.union(docs.limit(3)), marks).collect()
    assert len(rows) == docs.count() + 3
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"]))
    assert all(len(v) == 1 for v in by.values())
    empty = {next(iter(by[i]))[0] for i in (300, 301, 302)}
    assert len(empty) == 1 and 0 < empty.pop() < 1
    assert np.mean([next(iter(by[i]))[1] for i in range(200)]) > 0.98
    assert np.mean([next(iter(by[i]))[1] for i in range(200, 300)]) < 0.02


def test_without_labels_or_rows(spark, labelled):
    docs, marks = labelled
    none = quality.quality(docs, marks.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    assert quality.quality(docs.limit(0), marks).count() == 0
    one = quality.quality(docs, marks.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)


def test_cut_labels_keep_the_share(spark, labelled):
    docs, marks = labelled
    model = quality.train(docs, marks, rows=60)
    found = quality.score(docs.where("doc_id < 300"), model, ["doc_id"]).collect()
    assert 0.6 < np.mean([r["score"] for r in found]) < 0.75


def test_a_long_text_scores_as_in_one_piece(monkeypatch):
    rng = np.random.default_rng(4)
    long = " ".join("ab!"[: 1 + i % 3] * (1 + i % 4) for i in rng.integers(0, 50, 4000))
    texts = pa.array(["short one", long + " " + long, None, "", " ", "é ü ü ü", long], pa.string())

    def bags():
        return [dict(zip(k.tolist(), t.tolist())) for k, t in zip(*quality._bag(texts))]

    whole = bags()
    assert sum(whole[5].values()) > 6 and quality._REPEAT in whole[5]
    sizes = []
    monkeypatch.setattr(quality, "PIECE", 700)
    for _, data, bounds, _ in quality.pieces(texts):
        sizes.append(len(data))
    assert max(sizes) <= 700 and len(sizes) > 20
    assert bags() == whole


def test_a_run_without_blanks_is_cut(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 1000)
    keys, times = quality._bag(pa.array(["x" * 10_000, "y"], pa.string()))
    assert sum(times[0]) > 9000 and len(keys[1])


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(8)
    label = rng.integers(0, 2, 300)
    found = [np.unique(np.concatenate([rng.integers(0, 50, 6), 100 + 2 * rng.integers(0, 5, 2) + y])) for y in label]
    cuts = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    model = quality.fit(np.concatenate(found), np.concatenate([np.full(len(f), 1 / len(f)) for f in found]), cuts, label, epochs=20)
    each, bias = model.scorer()
    right = [(bias + each[f].mean() >= 0) == y for f, y in zip(found, label)]
    assert np.mean(right) > 0.98
    assert not model.vectors[200:].any()
