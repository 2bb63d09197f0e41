"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Words are runs of letters and digits, lower-cased in ASCII, told apart by 64-bit hashes. The vocabulary is a table of
all words of the corpus with their counts, stored by Spark, so it grows with the corpus. Its most frequent words,
``HEAD`` at most, are sorted by count into classes of about equal mass, and frequent ones have a class of their own; all others
are dealt by hash into further classes, as many as their mass fills, one at least. ``CLASSES`` is the number of both.

A small network, trained in numpy, sees the classes of the ``SIDE`` words before and after a place, not the place
itself, and gives the class there; given its class, a word has its own count, plus one, as its share of the class. The
probabilities of all words at a place add up to one, with one share in each class of the others left to words that the vocabulary lacks. The
log-probabilities of all places, each predicted from both sides, add up to the document's score. Shares of the head
are added where the network runs; the other words of a document leave it as counted pairs that Spark joins with the vocabulary. No
such word can be a hot key: more than ``HEAD`` words are about as frequent as it or more so.

Training is data-parallel over all documents: in each round every partition runs one pass of
minibatch steps over its documents from the common start, and the weights of all are averaged, in
proportion to their places, first in groups and then over the groups.
Only averages of groups reach the driver: their number is bounded. So scores depend a little on the number of partitions.

Null and texts without words have no places: score 0 and mean null. A text of one word is
predicted from padding alone. Words of equal count are classed in the order of their hashes. Extra columns are ignored; repeated
rows count each and score alike but for rounding. An empty corpus, or one without words, gives 0 throughout.
A very long text is one slice of :mod:`words`, held in memory as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import ALNUM, slices, words_of

HEAD = 1 << 16  # words that every task holds, at most
SLOT_BITS = 18
CLASS_SHIFT = 33  # the upper bits of a hash choose the class of a word outside the head
CLASSES = 64
SIDE = 2
HIDDEN = 16
ROUNDS = 2
BATCH = 8192
RATE = 0.5
GROUPS = 32  # averages of partitions that reach the driver

PAD = CLASSES  # beside the ends of a text


def _words(texts: pa.Array):
    """(index of the first text, hash of each word, bounds)."""
    for at, data, bounds in slices(texts, 1 << 20):
        found = words_of(data, bounds, ALNUM)
        yield at, found.hash, found.first


def count_words(docs: DataFrame) -> DataFrame:
    """The vocabulary: word (its hash) and n, how often it occurs in all documents; stored."""

    def run(batches):
        for batch in batches:
            for _, word, _ in _words(batch.column("text")):
                each, n = np.unique(word, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n)], ["word", "n"])

    return stored(docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def _level(n: Column) -> Column:
    """A count cut to its first two digits: few values, in the order of the counts."""
    unit = F.pow(F.lit(10), F.greatest(F.length(n.cast("string")) - 2, F.lit(0))).cast("bigint")
    return n - n % unit


def least_count(vocabulary: DataFrame, most: int) -> int:
    """The smallest level of counts that at most ``most`` words reach; one past the greatest where more reach each."""
    levels = vocabulary.groupBy(_level(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("top"))
    rows, words = sorted(levels.collect(), reverse=True), 0
    least = rows[0]["top"] + 1 if rows else 1
    for row in rows:
        words += row["words"]
        if words > most:
            break
        least = row["level"]
    return least


def classes_of(counts: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word, by falling count in classes of about equal mass, with one count added to each."""
    order = np.argsort(-counts, kind="stable")
    smooth = counts + 1.0
    left, out, at = smooth.sum(), np.zeros(len(counts), dtype=np.int64), 0
    for c in range(classes):
        goal, mass = left / (classes - c), 0.0
        to = at
        while to < len(counts) and (mass == 0 or mass + smooth[order[to]] <= goal or c == classes - 1):
            mass += smooth[order[to]]
            to += 1
        out[order[at:to]] = c
        left, at = left - mass, to
    return out


@dataclass
class Head:
    """The frequent words, and what the others' classes and shares need."""

    words: np.ndarray  # hashes, ascending
    slot: np.ndarray  # for each beginning of a hash the index of its most frequent word
    kind: np.ndarray  # class of each
    share: np.ndarray  # log-share of each in its class
    least: int  # words counted less often are not in the head
    first: int  # classes from here on are those of the other words
    totals: np.ndarray  # their masses, unknown words included

    def find(self, words: np.ndarray) -> np.ndarray:
        """The index of each word in the head, or -1."""
        if not len(self.words):
            return np.full(len(words), -1, dtype=np.int64)
        at = self.slot[words >> np.uint64(64 - SLOT_BITS)]
        miss = np.flatnonzero(self.words[at] != words)
        place = np.minimum(np.searchsorted(self.words, words[miss]), len(self.words) - 1)
        at[miss] = np.where(self.words[place] == words[miss], place, -1)
        return at

    def classes(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        other = self.first + ((words >> np.uint64(CLASS_SHIFT)) % np.uint64(len(self.totals))).astype(np.int64)
        return np.where(at >= 0, self.kind[at], other) if len(self.words) else other

    def other_share(self, word: Column, n: Column) -> Column:
        """Log-share in its class of a word outside the head, which occurs n times."""
        totals = F.array(*[F.lit(float(t)) for t in self.totals])
        place = F.shiftrightunsigned(word, CLASS_SHIFT) % F.lit(len(self.totals))
        return F.log((n + 1) / F.get(totals, place.cast("int")))


def head_of(vocabulary: DataFrame, most: int = HEAD) -> Head:
    """The words of at least some count, at most ``most``, their classes, and the masses of the others' classes."""
    least = least_count(vocabulary, most)
    rows = vocabulary.where(F.col("n") >= least).toArrow()
    words, counts = rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    others = vocabulary.where(F.col("n") < least)
    mass, others_mass = float((counts + 1.0).sum()), others.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    fill = round(CLASSES * others_mass / max(mass + others_mass, 1.0))
    others_classes = min(max(fill, 1), CLASSES - 1 if len(words) else CLASSES)
    first = CLASSES - others_classes
    totals = np.ones(others_classes)
    place = (F.shiftrightunsigned("word", CLASS_SHIFT) % F.lit(others_classes)).alias("place")
    for row in others.groupBy(place).agg(F.sum(F.col("n") + 1).alias("mass")).collect():
        totals[row["place"]] += row["mass"]
    kind = classes_of(counts, first)
    in_class = np.bincount(kind, weights=counts + 1.0, minlength=CLASSES)
    slot = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    rising = np.argsort(counts, kind="stable")
    slot[words[rising] >> np.uint64(64 - SLOT_BITS)] = rising
    return Head(words, slot, kind, np.log((counts + 1.0) / in_class[kind]), least, first, totals)


class Network:
    """One hidden layer over the classes of the words around a place."""

    def __init__(self, parameters: np.ndarray | None = None):
        shapes = [(2 * SIDE, CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
        sizes = [int(np.prod(s)) for s in shapes]
        if parameters is None:
            parameters = np.random.default_rng(5).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.all = parameters
        cuts = np.cumsum([0, *sizes])
        self.embed, self.hidden_bias, self.out, self.out_bias = (
            self.all[a:b].reshape(s) for a, b, s in zip(cuts[:-1], cuts[1:], shapes)
        )

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log-probabilities of the classes; ``context`` has a row per place."""
        hidden = self.embed[0][context[0]]
        for j in range(1, 2 * SIDE):
            hidden += self.embed[j][context[j]]
        hidden = np.tanh(hidden + self.hidden_bias)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return hidden, logits

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        hidden, logp = self.forward(context)
        n = len(target)
        slope = np.exp(logp)
        slope[np.arange(n), target] -= 1
        slope *= 1.0 / n
        back = (slope @ self.out.T) * (1 - hidden * hidden)
        self.out -= rate * (hidden.T @ slope)
        self.out_bias -= rate * slope.sum(axis=0)
        self.hidden_bias -= rate * back.sum(axis=0)
        for j in range(2 * SIDE):
            # Sums of rows by class: sort once, then add runs.
            order = np.argsort(context[j].astype(np.uint8), kind="stable")
            ordered = context[j][order]
            firsts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            self.embed[j][ordered[firsts]] -= rate * np.add.reduceat(back[order], firsts, axis=0)


def contexts(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the classes of the words before and after it, PAD beyond its text."""
    n = len(classes)
    begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    at, out = np.arange(n), np.empty((2 * SIDE, n), dtype=np.int64)
    for j, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        place = at + shift
        inside = (place >= begin) & (place < end)
        out[j] = np.where(inside, classes[np.clip(place, 0, max(n - 1, 0))], PAD) if n else PAD
    return out


def train(docs: DataFrame, head: Head, rounds: int = ROUNDS) -> np.ndarray:
    """The averaged parameters after some rounds over all documents."""
    context = docs.sparkSession.sparkContext
    parameters = Network().all
    for turn in range(rounds):
        held = context.broadcast((head, parameters))
        rate = RATE / (1 + turn)

        def run(batches):
            head, start = held.value  # noqa: B023
            net, places = Network(start.copy()), 0
            for batch in batches:
                for _, word, first in _words(batch.column("text")):
                    target = head.classes(word, head.find(word))
                    around = contexts(target, first)
                    for low in range(0, len(target), BATCH):
                        net.step(around[:, low : low + BATCH], target[low : low + BATCH], rate)  # noqa: B023
                    places += len(target)
            if places:
                group = TaskContext.get().partitionId() % GROUPS
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group]), pa.array([float(places)]), pa.array([net.all.tobytes()], pa.binary())], ["g", "places", "weights"]
                )

        def average(batches):
            # A group's rows follow each other; one sum is held at a time.
            now, total, places = None, None, 0.0
            for batch in batches:
                for g, n, w in zip(*(batch.column(c).to_pylist() for c in ("g", "places", "weights"))):
                    if g != now and now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([places]), pa.array([total.tobytes()], pa.binary())], ["places", "total"])
                        total, places = None, 0.0
                    now = g
                    own = np.frombuffer(w, dtype=np.float32).astype(np.float64) * n
                    total, places = own if total is None else total + own, places + n
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([places]), pa.array([total.tobytes()], pa.binary())], ["places", "total"])

        each = docs.select("text").mapInArrow(run, "g bigint, places double, weights binary")
        ordered = each.repartition("g").sortWithinPartitions("g", "places", "weights")
        rows = sorted((r["places"], bytes(r["total"])) for r in ordered.mapInArrow(average, "places double, total binary").collect())
        if not rows:
            return parameters
        total = sum(np.frombuffer(t, dtype=np.float64) for _, t in rows)
        parameters = (total / sum(n for n, _ in rows)).astype(np.float32)
    return parameters


def _counted(word: np.ndarray, text: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array]:
    """For each text its different words, and how often each occurs in it, as lists."""
    order = np.lexsort((word, text))
    word, text = word[order], text[order]
    starts = np.ones(len(word), dtype=bool)
    starts[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    firsts = np.flatnonzero(starts)
    bounds = pa.array(np.searchsorted(text[firsts], np.arange(texts + 1)).astype(np.int32))
    times = np.diff(np.append(firsts, len(word)))
    return pa.ListArray.from_arrays(bounds, pa.array(word[firsts].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times))


def score(docs: DataFrame, vocabulary: DataFrame, head: Head, parameters: np.ndarray) -> DataFrame:
    """doc_id, n_words, log_likelihood (natural, summed over all places) and mean_log_likelihood."""
    held = docs.sparkSession.sparkContext.broadcast((head, parameters))

    def run(batches):
        head, parameters = held.value
        net = Network(parameters)
        for batch in batches:
            for start, word, first in _words(batch.column("text")):
                at = head.find(word)
                target = head.classes(word, at)
                around = contexts(target, first)
                logp = np.zeros(len(target) + 1)
                if len(head.words):
                    logp[1:] = np.where(at >= 0, head.share[at], 0.0)
                for low in range(0, len(target), BATCH):
                    part = slice(low, low + BATCH)
                    _, p = net.forward(around[:, part])
                    logp[1:][part] += p[np.arange(len(p)), target[part]]
                np.cumsum(logp, out=logp)
                texts = len(first) - 1
                other = np.flatnonzero(at < 0)
                text = np.searchsorted(first, other, side="right") - 1
                lists = _counted(word[other], text, texts)
                ids = batch.column("doc_id").slice(start, texts)
                sums = pa.array(logp[first[1:]] - logp[first[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(first)), sums, *lists], ["doc_id", "n_words", "known", "word", "times"]
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    first = rows.mapInArrow(run, "doc_id bigint, n_words bigint, known double, word array<bigint>, times array<bigint>")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()))
    pairs = first.select("row", F.explode(F.arrays_zip("word", "times")).alias("p")).select("row", "p.word", "p.times")
    counts = vocabulary.where(F.col("n") < head.least)
    share = head.other_share(F.col("word"), F.coalesce("n", F.lit(0)))
    others = pairs.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * share).alias("others"))
    total = F.col("known") + F.coalesce("others", F.lit(0.0))
    return first.drop("word", "times").join(others, "row", "left").select(
        "doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood")
    )


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on all documents and score all of them."""
    vocabulary = count_words(docs)
    head = head_of(vocabulary)
    return score(docs, vocabulary, head, train(docs, head))
