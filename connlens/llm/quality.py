"""Quality scores by supervised subword embeddings.

A text is the bag of its words (runs without white space, case kept), its pairs of neighbouring words
and the byte n-grams of its words, blanks included as marks of their ends. Each of them
is hashed into a bucket with a learned vector; a text is the average of its vectors, and a softmax layer
tells the labels apart. A word that repeats the one before it is the same pair whatever the word, so a text that
stammers is known by words never seen. Vectors and output layer are trained by stochastic gradient descent in numpy
on a bounded sample of labelled rows. Buckets in few documents of the sample keep the zero vector, which draws the
average towards nothing, so they weigh as much as they are known.

Null, empty and blank texts score by the bias alone. A long text is read whole, in pieces of bounded size cut at
blanks, with the result of one piece; only a run of over ``PIECE`` bytes without a blank is cut inside. Extra
columns are ignored; each repeated row gets the same score; a doc_id with several labels has the least of them;
null labels, and others than 0 and 1, are not learned from. A score of just 0.5 predicts 1. Without labels every
score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .language import held_out
from .store import stored
from .words import NOT_BLANK, mix, words_of

BITS = 18
DIMENSIONS = 8
GRAMS = (3, 4)  # bytes of an n-gram
PIECE = 1 << 20
TRAIN_ROWS = 2000  # of each label, at most
LEAST_DOCS = 4  # a bucket in fewer documents of the sample has no vector

_SALT = mix(np.arange(8, dtype=np.uint64) + np.uint64(29)) | np.uint64(1)
_REPEAT = int(mix(np.array([41]))[0] >> np.uint64(64 - BITS))


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(index of the first text, bytes, bounds, whether it goes on with that text) of pieces of bounded size."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1
        if to > at:
            yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], False
            at = to
            continue
        low, high = int(ends[at]), int(ends[at + 1])
        on = False
        while low < high:
            stop = min(low + PIECE, high)
            if stop < high:
                blanks = np.flatnonzero(~NOT_BLANK[data[low + 1 : stop]])
                # The blank ends a word in this piece and begins one in the next.
                stop = low + int(blanks[-1]) + 2 if len(blanks) else stop
            part = data[low:stop]
            yield at, part, np.array([0, len(part)]), on
            low, on = (stop if stop == high or NOT_BLANK[data[stop - 1]] else stop - 1), True
        at += 1


def buckets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, buckets with repeats, the text of each, counted from the first) of pieces."""
    last = None
    for at, data, bounds, goes_on in pieces(texts):
        words = words_of(data, bounds, NOT_BLANK, lower=False)
        h = words.hash
        found, docs = [(mix(h * _SALT[0]) >> np.uint64(64 - BITS)).astype(np.int64)], [words.doc]
        before, after, doc = h[:-1], h[1:], words.doc[1:]
        same = words.doc[1:] == words.doc[:-1]
        before, after, doc = before[same], after[same], doc[same]
        if goes_on and last is not None and len(h):
            before, after, doc = np.append(before, last), np.append(after, h[0]), np.append(doc, 0)
        last = h[-1] if len(h) else last if goes_on else None
        pair = (mix(before * _SALT[1] + mix(after) * _SALT[2]) >> np.uint64(64 - BITS)).astype(np.int64)
        found.append(np.where(before == after, _REPEAT, pair))
        docs.append(doc)
        n = len(data)
        inside = NOT_BLANK[data]
        byte = np.where(inside, data, np.uint8(32)).astype(np.uint64)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for size in GRAMS:
            if n < size:
                continue
            value, whole = np.zeros(n - size + 1, dtype=np.uint64), text[: n - size + 1] == text[size - 1 :]
            for j in range(size):
                value = (value << np.uint64(8)) | byte[j : n - size + 1 + j]
                if 0 < j < size - 1:
                    whole &= inside[j : n - size + 1 + j]
            value = value[whole] * _SALT[size]
            found.append(((value ^ (value >> np.uint64(31))) * _SALT[7] >> np.uint64(64 - BITS)).astype(np.int64))
            docs.append(text[: n - size + 1][whole])
        yield at, np.concatenate(found), np.concatenate(docs)


@dataclass
class Model:
    vectors: np.ndarray  # a row per bucket
    output: np.ndarray  # dimensions x labels
    bias: np.ndarray  # one per label

    def scorer(self) -> tuple[np.ndarray, float]:
        """What a bucket adds to the log odds of label 1 once averaged, and the log odds without any."""
        side = self.output[:, 1] - self.output[:, 0]
        return (self.vectors @ side).astype(np.float32), float(self.bias[1] - self.bias[0])


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def fit(found: np.ndarray, share: np.ndarray, cuts: np.ndarray, label: np.ndarray, epochs: int = 4, batch: int = 64) -> Model:
    """found: the distinct buckets of all texts, text by text as ``cuts`` says; share: of all buckets of the text.

    AdaGrad steps on the cross entropy of the softmax, over batches of texts in random order.
    """
    rng = np.random.default_rng(13)
    docs = len(label)
    often = np.bincount(found, minlength=1 << BITS)
    known = np.flatnonzero(often >= min(LEAST_DOCS, max(1, docs // 20)))
    slot = np.full(1 << BITS, -1)
    slot[known] = np.arange(len(known))
    live = np.flatnonzero(slot[found] >= 0)
    own, share, cuts = slot[found[live]], share[live], np.searchsorted(live, cuts)
    vectors, grown = np.zeros((len(known), DIMENSIONS)), np.full((len(known), DIMENSIONS), 1e-8)
    output = rng.normal(0, 1, (DIMENSIONS, 2))
    bias = np.log(np.maximum(np.bincount(label, minlength=2), 0.5) / docs)
    grown_output, grown_bias = np.full(output.shape, 1e-2), np.full(2, 1e-2)
    for epoch in range(epochs):
        order = rng.permutation(docs)
        rate = 1 - epoch / epochs
        for low in range(0, docs, batch):
            some = order[low : low + batch]
            n = cuts[some + 1] - cuts[some]
            part = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(cuts[some] - part[:-1], n) + np.arange(part[-1])
            rows, weight = own[at], share[at]
            hidden = _sums(vectors[rows] * weight[:, None], part)
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            slope = p / p.sum(axis=1, keepdims=True)
            slope[np.arange(len(some)), label[some]] -= 1
            slope /= len(some)
            down = np.repeat(slope @ output.T, n, axis=0) * weight[:, None]
            hit = np.flatnonzero(np.bincount(rows, minlength=len(known)))
            step = np.stack([np.bincount(rows, weights=down[:, d], minlength=len(known))[hit] for d in range(DIMENSIONS)], axis=1)
            grown[hit] += step**2
            vectors[hit] -= 2.0 * rate * step / np.sqrt(grown[hit])
            step = hidden.T @ slope + 1e-4 * output
            grown_output += step**2
            output -= 0.1 * rate * step / np.sqrt(grown_output)
            step = slope.sum(axis=0)
            grown_bias += step**2
            bias -= 0.1 * rate * step / np.sqrt(grown_bias)
    whole = np.zeros((1 << BITS, DIMENSIONS), dtype=np.float32)
    whole[known] = vectors
    return Model(whole, output, bias)


def _bag(batch_texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct buckets of each text, and how often it has them."""
    keys, times = [[] for _ in range(len(batch_texts))], [[] for _ in range(len(batch_texts))]
    for at, found, docs in buckets(batch_texts):
        key, count = np.unique((docs << BITS) | found, return_counts=True)
        doc = key >> BITS
        cuts = np.searchsorted(doc, np.arange(doc[-1] + 2)) if len(doc) else np.zeros(1, dtype=np.int64)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                keys[at + i].append(key[a:b] & ((1 << BITS) - 1))
                times[at + i].append(count[a:b])
    for i, parts in enumerate(keys):
        if len(parts) > 1:  # the pieces of a long text
            keys[i], back = np.unique(np.concatenate(parts), return_inverse=True)
            times[i] = np.bincount(back, weights=np.concatenate(times[i]))
        else:
            keys[i] = parts[0] if parts else np.zeros(0, dtype=np.int64)
            times[i] = times[i][0] if parts else np.zeros(0)
    return keys, times


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` documents of each label, taken by hash; the bias undoes the choice.

    Only the hashed buckets of the sample reach the driver.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = clean.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not count:
        return None
    # Four times the quota is enough for the ranking to fill it, and bounds what it ranks.
    share = F.lit(1.0)
    for value, n in count.items():
        share = F.when(F.col("quality") == value, min(1.0, 4.0 * rows / n)).otherwise(share)
    chance = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = stored(known.where(chance < share).withColumn("_rank", rank).where(F.col("_rank") <= rows).select("doc_id", "quality"))
    taken = {r["quality"]: r["count"] for r in picked.groupBy("quality").count().collect()}
    # One row of a repeated doc_id, so that the bound holds whatever the table: at most 2 x rows pairs of numbers are sent.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def extract(batches):
        for batch in batches:
            keys, times = _bag(batch.column("text"))
            arrays = [pa.array([k.astype("<u4").tobytes() for k in keys], pa.binary()), pa.array([(t / max(t.sum(), 1)).astype("<f4").tobytes() for t in times], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *arrays], ["doc_id", "quality", "x", "share"])

    got = sample.mapInArrow(extract, "doc_id bigint, quality int, x binary, share binary").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    parts = [np.frombuffer(x, dtype="<u4") for x in got["x"].to_pylist()]
    shares = [np.frombuffer(x, dtype="<f4") for x in got["share"].to_pylist()]
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    model = fit(np.concatenate(parts).astype(np.int64), np.concatenate(shares), cuts, got["quality"].to_numpy().astype(np.int64))
    for value, n in taken.items():
        model.bias[value] += np.log(count[value] / n)
    return model


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, score and predicted of every row; the whole text counts."""
    held = docs.sparkSession.sparkContext.broadcast(model.scorer() if model else None)  # a number per bucket
    kept = docs.select(*keep, F.col("text").alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches):
        own = held.value
        for batch in batches:
            total, number = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, found, docs in buckets(batch.column("_text")) if own else ():
                n = int(docs.max(initial=-1)) + 1
                total[at : at + n] += np.bincount(docs, weights=own[0][found], minlength=n)
                number[at : at + n] += np.bincount(docs, minlength=n)
            odds = (own[1] if own else 0.0) + total / np.maximum(number, 1)
            p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            arrays = [*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "score", "predicted"])

    return kept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from labels of those not held out."""
    model = train(docs, labels.where(~held_out(3, 1)))
    marked = docs.select("doc_id", "text", held_out(3, 1).alias("held_out"))
    return score(marked, model, ["doc_id", "held_out"])
