"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One binary classifier per bit, logistic
regression over hashed byte n-grams, says which value the bit has; a text gets the language
whose codeword costs least, where a bit counts by how well its classifier does
(loss-weighted decoding). A text whose two best languages cost nearly the same
is flagged as ambiguous; of equally near ones the first by name is taken.

Null, and text without any letter, is ``und`` with score 0. Any other text gets
a learned language, however short. Extra columns are ignored; a repeated row
gets the same result each time. Without any labelled row all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import LOWER, mix, slices

BUCKETS = 1 << 12
ROWS = 256  # texts with a row of features at a time
TRAIN_ROWS = 6000  # bound of the labelled sample, over all languages
LEAST_ROWS = 20  # of each language, if it has them
AMBIGUOUS = 0.1  # flagged below this lead of the best over the second, in probability
CERTAIN = 200  # characters from which a text should have one language
UND = "und"

_SEEDS = mix(np.arange(3, dtype=np.uint64) + np.uint64(11)) | np.uint64(1)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first text, a row per text): square roots of n-gram shares, of length 1.

    N-grams of one to three bytes, lower-cased in ASCII; other than letters
    count as one blank, so digits and punctuation say nothing.
    """
    letter = np.zeros(256, dtype=bool)
    letter[0x61:0x7B] = True
    letter[0x80:] = True
    for at, data, bounds in _few(texts):
        data = np.where(letter[LOWER[data]], LOWER[data], np.uint8(32)).astype(np.uint32)
        n, rows = len(data), len(bounds) - 1
        out = np.zeros((rows, BUCKETS), dtype=np.float32)
        if n:
            buckets = []
            value = np.zeros(n, dtype=np.uint32)
            for size in range(3):
                rolled = np.zeros(n, dtype=np.uint32)
                rolled[: n - size] = data[size:]
                value = value * np.uint32(256) + rolled
                hashed = (value * np.uint32(_SEEDS[size] & np.uint64(0xFFFFFFFF))) >> np.uint32(20)
                buckets.append(hashed.astype(np.int64))
            for i in range(rows):
                a, b = bounds[i], bounds[i + 1]
                if a == b:
                    continue
                for size, hashed in enumerate(buckets):
                    if b - size > a:
                        out[i] += np.bincount(hashed[a : b - size], minlength=BUCKETS)
            blank = [int(h[0]) for h in _blank_buckets()]
            out[:, blank] = 0
            np.sqrt(out, out=out)
            out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-6)
        yield at, out


def _few(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of at most ``ROWS`` texts, so that short texts take no more room than long ones."""
    for at, data, bounds in slices(texts, 1 << 20):
        for low in range(0, len(bounds) - 1, ROWS):
            own = bounds[low : low + ROWS + 1]
            yield at + low, data[own[0] : own[-1]], own - own[0]


def _blank_buckets() -> list[np.ndarray]:
    """The buckets of one, two and three blanks."""
    value, found = np.zeros(1, dtype=np.uint32), []
    for size in range(3):
        value = value * np.uint32(256) + np.uint32(32)
        found.append((value * np.uint32(_SEEDS[size] & np.uint64(0xFFFFFFFF))) >> np.uint32(20))
    return found


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 per class. Up to 6 classes: every split of them; else spread-out random words."""
    if classes < 2:
        return np.ones((classes, 0), dtype=np.float32)
    if classes <= 6:
        splits = [[(s >> c) & 1 for c in range(classes)] for s in range(1, 1 << (classes - 1))]
        return np.array(splits, dtype=np.float32).T * 2 - 1
    bits, best, rank = 10 * int(np.ceil(np.log2(classes))), None, -1
    rng = np.random.default_rng(7)
    for _ in range(200):
        code = rng.integers(0, 2, (classes, bits)).astype(np.float32) * 2 - 1
        apart = bits - (code @ code.T + bits) / 2 + np.eye(classes) * bits
        balanced = np.all(np.abs(code.sum(axis=0)) < classes)
        if balanced and apart.min() > rank:
            best, rank = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits: how well the classifier of a bit does on a language
    scale: float = 1.0  # sharpens costs into probabilities

    def costs(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weight + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(axis=2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        cost = -self.scale * self.costs(x)
        cost -= cost.max(axis=1, keepdims=True)
        p = np.exp(cost)
        return p / p.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, languages: list[str], rounds: int = 150, rate: float = 4.0, decay: float = 1e-5) -> Model:
    """Fit the bits side by side by full-batch gradient steps with momentum, classes weighted alike."""
    names = sorted(set(languages))
    index = np.array([names.index(v) for v in languages])
    code = codewords(len(names))
    bits = code.shape[1]
    weight, bias = np.zeros((BUCKETS, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
    each = 1.0 / np.maximum(np.bincount(index, minlength=len(names)), 1)[index].astype(np.float32)
    each /= each.sum()
    goal, speed, bias_speed = code[index], np.zeros_like(weight), np.zeros_like(bias)
    for _ in range(rounds if bits else 0):
        margin = (x @ weight + bias) * goal
        slope = (-goal / (1 + np.exp(np.clip(margin, -30, 30)))) * each[:, None]
        speed = 0.9 * speed - rate * (x.T @ slope + decay * weight)
        bias_speed = 0.9 * bias_speed - rate * 0.1 * slope.sum(axis=0)
        weight, bias = weight + speed, bias + bias_speed
    right = ((x @ weight + bias) * goal > 0).astype(np.float32)
    trust = np.stack([right[index == c].mean(axis=0) for c in range(len(names))]) if bits else code
    if bits:
        trust = np.maximum(trust, 1e-3)
        trust = trust / trust.sum(axis=1, keepdims=True)
    return Model(names, code, weight, bias, trust.astype(np.float32), scale=4.0)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on a sample of at most ``rows`` documents that have a language, shared among the languages.

    The sample is taken by hash, so that it is the same each time; only its n-gram
    shares reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("_n"))  # one row per language
    languages = sizes.count()
    if not languages:
        return None
    quota = max(LEAST_ROWS, rows // languages)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Four times the quota is enough for the ranking to fill it, and bounds what it ranks of a frequent language.
    chance = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    picked = (
        known.select("doc_id", "lang")
        .join(sizes, "lang")
        .where(chance < F.lit(4.0 * quota) / F.col("_n"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= quota)
        .select("doc_id", F.col("lang").alias("_lang"))
    )
    # At most rows + LEAST_ROWS x languages identifiers.
    sample = known.join(F.broadcast(picked.distinct()), "doc_id").where(F.col("lang") == F.col("_lang"))

    def extract(batches):
        for batch in batches:
            for at, x in features(batch.column("text")):
                part = batch.column("lang").slice(at, len(x))
                data = pa.array([row.astype(np.float16).tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part, data], ["lang", "x"])

    got = sample.select("lang", "text").mapInArrow(extract, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    parts = got.to_batches()
    del got
    return fit(*_in_order(parts))


def _in_order(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, list[str]]:
    """The features and languages of all parts in an order that does not depend on theirs. Empties the list, so rows are not held twice."""

    def rows(part: pa.RecordBatch) -> np.ndarray:
        x = part.column("x").cast(pa.large_binary())
        first = np.frombuffer(x.buffers()[1], dtype=np.int64)[x.offset] if len(x) else 0
        return np.frombuffer(x.buffers()[2] or b"", dtype=np.uint8)[first : first + len(x) * 2 * BUCKETS].view(np.float16).reshape(len(x), BUCKETS)

    languages = [name for part in parts for name in part.column("lang").to_pylist()]
    order = np.lexsort((np.concatenate([rows(part)[:, :64].astype(np.float32).sum(axis=1) for part in parts]), languages))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    x, at = np.empty((len(order), BUCKETS), dtype=np.float32), 0
    parts.reverse()
    while parts:
        own = rows(parts.pop())
        for low in range(0, len(own), ROWS):
            part = own[low : low + ROWS]
            x[place[at : at + len(part)]] = part
            at += len(part)
    return x, [languages[i] for i in order]


SCHEMA = "lang_pred string, score double, ambiguous boolean"


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row, and its language, score and flag. The text is read whole, and sent once.

    Rows come back a few at a time, so a batch of large rows is not held twice.
    """
    sent = [*keep, *([] if text in keep else [text])]
    kept = docs.select(*sent, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", " + SCHEMA

    def run(batches):
        for batch in batches:
            letter = np.asarray(batch.column("_letter").to_numpy(zero_copy_only=False), dtype=bool)
            for at, x in features(batch.column(text)):
                ok = letter[at : at + len(x)]
                if model is None:
                    best, score, lead = None, np.zeros(len(x)), np.ones(len(x))
                else:
                    p = model.probabilities(x)
                    order = np.sort(p, axis=1)
                    best, score = p.argmax(axis=1), order[:, -1]
                    lead = score - (order[:, -2] if p.shape[1] > 1 else 0)
                names = [UND if best is None or not ok[i] else model.languages[best[i]] for i in range(len(x))]
                arrays = [batch.column(c).slice(at, len(x)) for c in keep]
                arrays += [pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0).astype(np.float64)), pa.array(ok & (lead < AMBIGUOUS))]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score", "ambiguous"])

    return kept.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int) -> F.Column:
    """crc32 of doc_id as text, by its remainder; a null doc_id counts as empty text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % F.lit(modulus) == F.lit(remainder)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the language of every document, learned from those not held out."""
    model = train(docs.where(~held_out(4, 2)))
    marked = docs.select("doc_id", "text", held_out(4, 2).alias("held_out"))
    return predict(marked, model, ["doc_id", "held_out"])


def known_only(docs: DataFrame) -> DataFrame:
    """Documents in a known language, all columns as they are, whatever their names.

    Texts without a letter go, and those that the classifiers cannot tell: ambiguous ones of two languages at once, of
    ``CERTAIN`` characters or more. Shorter ones stay, as little text is no sign of a bad one. Without any label there
    is nothing to tell by, and all texts with a letter stay.
    """
    model = train(docs)
    names = docs.columns
    plain = [f"k{i}" for i in range(len(names))]
    text = plain[names.index("text")]
    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, plain)])
    if model is None:
        found = renamed.where(F.col(text).rlike(r"\p{L}"))
    else:
        doubtful = F.col("ambiguous") & (F.length(text) >= CERTAIN)
        found = predict(renamed, model, plain, text).where((F.col("lang_pred") != UND) & ~doubtful)
    return found.select(*[F.col(k).alias(c) for c, k in zip(names, plain)])
