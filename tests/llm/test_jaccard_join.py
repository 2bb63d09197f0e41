"""The near-duplicate join where pairs are many: near copies below the threshold, hot lists, and doc_ids with several texts."""

import numpy as np
import pyarrow as pa
import pytest

from connlens.llm import jaccard

SCHEMA = "doc_id bigint, text string, unit string, c int"


def shingles(text):
    words = (text or "").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def by_hand(rows):
    """(doc_id, size, component) of each row; documents of one doc_id are one node, rows without one their own."""
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    def join(i, j):
        at[find(i)] = find(j)

    first = {}
    for i, (d, t) in enumerate(rows):
        key = ("id", d) if d is not None else ("text", t)
        join(i, first.setdefault(key, i))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=str)


def below_threshold(copies, words, changed, seed=3):
    """Near copies of one text, each with ``changed`` words of its own at random places."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for k in range(copies):
        own = list(base)
        for place in rng.choice(words, changed, replace=False):
            own[place] = f"x{k}y{place}"
        rows.append((1000 + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [40, jaccard.BLOCK])
def test_many_near_copies_just_under_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", 20)
    rows = below_threshold(300, 150, 3) + below_threshold(40, 120, 2, 5)
    rows += [(5000 + i, r[1] + " end") for i, r in enumerate(rows[::7])]
    expected = by_hand(rows)
    # Most are apart, some are linked, and not all through the least of them.
    sizes = {c: sum(1 for r in expected if r[2] == c) for c in {r[2] for r in expected}}
    assert len(sizes) > 30 and max(sizes.values()) > 2
    assert found(spark, rows) == expected


def test_few_pairs_leave_a_hot_list(monkeypatch):
    """Pairs of a list are ruled out in place, by bitmaps of any width."""
    rng = np.random.default_rng(1)
    sets = []
    for k in range(200):
        n = int(rng.integers(90, 700))
        shared = np.arange(40, dtype=np.uint64)
        sets.append(np.concatenate([shared, rng.integers(1 << 20, 1 << 62, n - 40).astype(np.uint64)]))
    sets.append(np.concatenate([sets[0][:-2], [np.uint64(7 << 50)]]))
    sets.append(np.concatenate([sets[1][:-2], [np.uint64(9 << 50)]]))
    sizes, number = np.array([len(s) for s in sets]), np.arange(len(sets))
    parity = np.stack([np.frombuffer(jaccard._folded(jaccard._parity(s)), dtype=np.uint64) for s in sets])
    rows = {x: np.zeros(len(sets), dtype=np.int64) for x in ("place", "main", "side")}
    rows |= {"g": number, "r": number, "c": number + 1, "n": sizes, "size": sizes, "whole": rows["main"] + 1}
    for pairs in (1 << 17, 50):
        monkeypatch.setattr(jaccard, "PAIRS", pairs)
        u, v = jaccard._survivors(rows["main"], rows, parity)
        assert {(0, 200), (1, 201)} <= set(zip(u.tolist(), v.tolist())) and len(u) < 20
        # Within one component there is nothing to do, nor between keys, nor within one of two blocks.
        assert not len(jaccard._survivors(rows["main"], rows | {"c": rows["main"]}, parity)[0])
        assert not len(jaccard._survivors(number, rows, parity)[0])
        assert not len(jaccard._survivors(rows["main"], rows | {"whole": rows["main"]}, parity)[0])
        apart = jaccard._survivors(rows["main"], rows | {"whole": rows["main"], "side": number // 200}, parity)
        assert (0, 200) in set(zip(*(x.tolist() for x in apart)))
        # Sets of one group are compared as well, sets of the main component among themselves are not.
        together = jaccard._survivors(rows["main"], rows | {"g": rows["main"], "n": rows["whole"]}, parity)
        assert (0, 200) in set(zip(*(x.tolist() for x in together)))
        main = rows | {"c": np.where(number % 200 == 0, 0, number)}
        assert set(zip(*(x.tolist() for x in jaccard._survivors(rows["main"], main, parity)))) & {(0, 200), (1, 201)} == {(1, 201)}


def test_a_doc_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (5, a), (5, b), (9, b), (9, ""), (7, None), (7, a + " more"), (20, "one two"), (None, b), (None, "alone here"), (-3, "minus"), (21, "minus")]
    assert found(spark, rows) == by_hand(rows)


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, f"u{i}", i) for i, r in enumerate(rows)], SCHEMA)
    stay = jaccard.one_of_each(docs)
    assert stay.columns == docs.columns and stay.dtypes == docs.dtypes
    return sorted(((r.doc_id, r.text) for r in stay.collect()), key=str)


def test_every_text_has_a_like_one_that_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    assert kept(spark, [(1, a), (5, a), (5, b), (9, b)]) == [(1, a), (5, b)]
    rows = [(1, a), (1, a), (2, None), (2, None), (3, ""), (None, b), (None, b), (9, b + " end"), (None, "alone here")]
    expected = [(1, a), (2, None), (2, None), (3, ""), (9, b + " end"), (None, "alone here")]
    assert kept(spark, rows) == sorted(expected, key=str)
    assert kept(spark, [(2, a), (3, a + " end")]) == [(2, a)]


def test_one_of_each_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard.one_of_each(docs).count() == 0


def test_words_of_a_large_batch_are_held_in_small_parts(monkeypatch):
    held, plain = [], jaccard.words_of

    def measured(data, *others):
        held.append(len(data))
        return plain(data, *others)

    texts = pa.array([f"{i} " * 200 for i in range(1500)])
    monkeypatch.setattr(jaccard, "words_of", measured)
    sets = [own for _, own in jaccard._sets(texts)]
    assert len(sets) == 1500 and all(len(own) == 1 for own in sets)
    assert sum(held) == sum(map(len, texts.to_pylist())) and max(held) <= 1 << 18
