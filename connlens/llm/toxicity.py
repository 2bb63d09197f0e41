"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its words (letters and digits, lower-cased in ASCII), hashed into buckets. The
score is the logistic function of bias + sum of the words' weights + sum over all pairs of
words of the product of their factors, so an insult can weigh more beside a group's name.
It is fitted with numpy on a bounded sample of labelled rows; a soft threshold keeps the
weight of a word at 0 unless it tells something. Words get factors that have a weight, or tell
something in a pair: for that, factors of all words are first fitted to what the weights
leave over. Words not seen in the sample count for nothing.

Null and empty texts score by the bias alone. Extra columns are ignored; a doc_id with several labels
counts as toxic if one of them says so; null labels are not learned from.
Without labels every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .language import held_out
from .store import stored
from .words import ALNUM, slices, words_of

BITS = 18
FACTORS = 8
TRAIN_ROWS = 6000  # of each label, at most
LEAST_DOCS = 5  # a bucket in fewer documents of the sample is left out
CHANCE = 4.0  # standard deviations of chance that a word's effect must pass
SCREEN = 4  # epochs after which words without a weight are left out, unless they tell something in a pair
PAIR_EPOCHS = 10  # of the search for such pairs
GROWN = 0.1  # length of the factors from which a word tells something; they begin at about 0.03


def terms(texts: pa.Array):
    """(index of the first text, distinct buckets of all texts, bounds) for slices of texts."""
    for at, data, bounds in slices(texts):
        found = words_of(data, bounds, ALNUM)
        key = (found.doc.astype(np.uint64) << np.uint64(BITS)) | (found.hash >> np.uint64(64 - BITS))
        key = np.unique(key)
        doc = (key >> np.uint64(BITS)).astype(np.int64)
        cuts = np.searchsorted(doc, np.arange(found.texts + 1))
        yield at, (key & np.uint64((1 << BITS) - 1)).astype(np.int64), cuts


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows between cuts; 0 where there are none."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # one per bucket
    slot: np.ndarray  # the row in ``factor`` of each bucket, 0 for none
    factor: np.ndarray  # a row of zeros, then one row per bucket with factors

    def margins(self, buckets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        live = np.flatnonzero((self.weight[buckets] != 0) | (self.slot[buckets] != 0))
        cuts, buckets = np.searchsorted(live, cuts), buckets[live]
        v = self.factor[self.slot[buckets]].astype(np.float64)
        pairs = (_sums(v, cuts) ** 2 - _sums(v * v, cuts)).sum(axis=1) / 2
        return self.bias + _sums(self.weight[buckets].astype(np.float64), cuts) + pairs


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _paired(own: np.ndarray, cuts: np.ndarray, label: np.ndarray, margin: np.ndarray, chance: np.ndarray, batch: int) -> np.ndarray:
    """Which words tell something beside others, given the margins of the weights alone.

    All words have factors here. Those of a word shrink by what chance would tell of it beside the words it stands with.
    """
    rng, size = np.random.default_rng(12), len(chance)
    v, g = rng.normal(0, 0.01, (size, FACTORS)), np.full((size, FACTORS), 1e-2)
    v[0] = 0
    for _ in range(PAIR_EPOCHS):
        order = rng.permutation(len(label))
        for low in range(0, len(label), batch):
            some = order[low : low + batch]
            n = cuts[some + 1] - cuts[some]
            part = np.concatenate([[0], np.cumsum(n)])
            at = own[np.repeat(cuts[some] - part[:-1], n) + np.arange(part[-1])]
            own_v = v[at]
            sums = _sums(own_v, part)
            slope = (_logistic(margin[some] + (sums**2 - _sums(own_v**2, part)).sum(axis=1) / 2) - label[some]) / len(some)
            inside = np.repeat(sums, n, axis=0) - own_v
            pull = np.repeat(slope, n)[:, None] * inside
            times = np.bincount(at, minlength=size)
            hit = np.flatnonzero(times)
            step = np.stack([np.bincount(at, weights=pull[:, f], minlength=size)[hit] for f in range(FACTORS)], axis=1)
            beside = np.sqrt(np.bincount(at, weights=(inside**2).sum(axis=1), minlength=size)[hit] / times[hit])
            g[hit] += step**2
            rate = 0.05 / np.sqrt(g[hit])
            row = v[hit] - rate * step
            length = np.sqrt((row**2).sum(axis=1))
            v[hit] = row * np.maximum(1 - rate.mean(axis=1) * chance[hit] * beside / np.maximum(length, 1e-12), 0)[:, None]
    return (v**2).sum(axis=1) > GROWN**2


def fit(buckets: np.ndarray, cuts: np.ndarray, label: np.ndarray, epochs: int = 40, batch: int = 256) -> Machine:
    """AdaGrad steps with a soft threshold on the weights, and decay on the factors."""
    rng = np.random.default_rng(11)
    docs, often = len(label), np.bincount(buckets, minlength=1 << BITS)
    kept = often >= min(LEAST_DOCS, max(1, docs // 20))
    known = np.flatnonzero(kept)
    slot = np.zeros(1 << BITS, dtype=np.int64)
    slot[known] = np.arange(1, len(known) + 1)
    size = len(known) + 1
    live = np.flatnonzero(kept[buckets])
    own, cuts = slot[buckets[live]], np.searchsorted(live, cuts)
    w, v = np.zeros(size), rng.normal(0, 0.01, (size, FACTORS))
    v[0] = 0
    gw, gv, bias, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-2), 0.0, 1e-6
    # The threshold of a word is what chance alone would tell of it, for each batch that has it.
    share, mean = np.bincount(own, minlength=size) / docs, label.mean()
    seen = np.maximum(1 - (1 - np.minimum(share, 1)) ** min(batch, docs), 1e-9)
    chance = np.sqrt(share * mean * (1 - mean) / docs) / seen
    least, stay = CHANCE * chance, np.zeros(size, dtype=bool)
    for epoch in range(epochs):
        if epoch == SCREEN:
            # Words without a weight by now are out of the running, but for those that tell something in a pair.
            stay = _paired(own, cuts, label, bias + _sums(w[own], cuts), chance, batch)
            live = np.flatnonzero((w[own] != 0) | stay[own])
            own, cuts = own[live], np.searchsorted(live, cuts)
            least *= 0.02  # those left need not shrink for it
        order = rng.permutation(docs)
        for low in range(0, docs, batch):
            some = order[low : low + batch]
            n = cuts[some + 1] - cuts[some]
            part = np.concatenate([[0], np.cumsum(n)])
            at = own[np.repeat(cuts[some] - part[:-1], n) + np.arange(part[-1])]
            active = ((w[at] != 0) | stay[at])[:, None]
            own_v = v[at] * active
            sums = _sums(own_v, part)
            margin = bias + _sums(w[at], part) + (sums**2 - _sums(own_v**2, part)).sum(axis=1) / 2
            slope = (_logistic(margin) - label[some]) / len(some)
            each = np.repeat(slope, n)
            dw = np.bincount(at, weights=each, minlength=size)
            touched = np.unique(at)
            gw[touched] += dw[touched] ** 2
            rate = 0.3 / np.sqrt(gw[touched])
            moved = w[touched] - rate * dw[touched]
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - rate * least[touched], 0)
            gb += slope.sum() ** 2
            bias -= 0.3 / np.sqrt(gb) * slope.sum()
            if epoch >= 2 and active.any():
                inside = np.repeat(sums, n, axis=0) - own_v
                some_v = np.flatnonzero(active[:, 0])
                rows = at[some_v]
                dv = np.stack([np.bincount(rows, weights=each[some_v] * inside[some_v, f], minlength=size) for f in range(FACTORS)], axis=1)
                hit = np.unique(rows)
                step = dv[hit] + 1e-4 * v[hit]
                gv[hit] += step**2
                v[hit] -= 0.05 / np.sqrt(gv[hit]) * step
    weight = np.zeros(1 << BITS, dtype=np.float32)
    weight[known] = w[1:]
    used = np.flatnonzero((w != 0) | stay)
    final = np.zeros(1 << BITS, dtype=np.int32)
    final[known[used - 1]] = np.arange(1, len(used) + 1)
    return Machine(float(bias), weight, final, np.concatenate([np.zeros((1, FACTORS)), v[used]]).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """Fit on at most ``rows`` documents of each label, taken by hash; the bias undoes the choice.

    Where one label is cut more than the other, the fitted odds are off by the ratio of their shares taken;
    its logarithm is taken from the bias. Only the hashed words of the sample reach the driver.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = clean.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not count:
        return None
    # Four times the quota is enough for the ranking to fill it, and bounds what it ranks.
    share = F.lit(1.0)
    for value, n in count.items():
        share = F.when(F.col("toxic") == value, min(1.0, 4.0 * rows / n)).otherwise(share)
    chance = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = stored(known.where(chance < share).withColumn("_rank", rank).where(F.col("_rank") <= rows).select("doc_id", "toxic"))
    taken = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 x rows pairs of numbers

    def extract(batches):
        for batch in batches:
            for at, buckets, cuts in terms(batch.column("text")):
                own = [buckets[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(own)), batch.column("toxic").slice(at, len(own)), pa.array(own, pa.binary())],
                    ["doc_id", "toxic", "x"],
                )

    got = sample.mapInArrow(extract, "doc_id bigint, toxic int, x binary").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    parts = [np.frombuffer(x, dtype="<u4") for x in got["x"].to_pylist()]
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    model = fit(np.concatenate(parts).astype(np.int64), cuts, got["toxic"].to_numpy().astype(np.float64))
    if len(taken) == 2:
        model.bias += float(np.log(count[1] / taken[1]) - np.log(count[0] / taken[0]))
    return model


def score(docs: DataFrame, model: Machine | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, score and predicted of every row; the whole text counts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col("text").alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches):
        own = held.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, buckets, cuts in terms(batch.column("_text")):
                scores.append(np.zeros(len(cuts) - 1) if own is None else _logistic(own.margins(buckets, cuts)))
            p = np.concatenate(scores)
            arrays = [*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "score", "predicted"])

    return kept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from labels of those not held out."""
    model = train(docs, labels.where(~held_out(5, 0)))
    marked = docs.select("doc_id", "text", held_out(5, 0).alias("held_out"))
    return score(marked, model, ["doc_id", "held_out"])
