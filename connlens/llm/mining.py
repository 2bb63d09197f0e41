"""Hard negatives by bounds along a spanning tree of the anchors.

Anchors are dealt into blocks of bounded size, and each block gets the spanning tree of least total distance. For a chunk
of candidate rows the scores at the root are computed; a child's score lies within (edge distance) x (norm of the
candidate) of its parent's, so most candidates are known to miss the child's window without a product. Only those
whose bounds overlap the window are scored again; the others hand on their widened bounds.

Two passes over the rows for each block of anchors: the first finds the positives (the window is what still beats
the weakest positive known so far), the second the negatives (windows from the positives' scores, narrowed to what
still beats the last negative known so far). Tasks keep a few rows for each anchor, and a row_number ranks those of
all tasks. Memory: one block of anchors, its lists, and bounds of one chunk for the anchors on one path of the tree.

Rows with null label, null or empty vector, a null or non-finite component take no part, nor do vectors of another
length than the most frequent one (of equally frequent ones: the shortest). Rows without vec_id are no anchors, but
candidates, last among ties. Each repeated row counts by itself; "other" rows of an anchor are those of another vec_id. Scores
are exact up to 2^63 in size, and taken as that beyond. Extra columns are ignored; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, shared_folder, stored
from .whitening import usable

BLOCK = 4096  # anchors in one tree, about
CHUNK = 1 << 17  # entries of vectors worked on at once
POSITIVES = 5
NEGATIVES = 5
LEAST = 80  # percent of the positive's score that a negative must have
NO_ID = np.iinfo(np.int64).max
BIG = 2.0**53


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label as the contract changes it, and the vector in whole numbers."""
    rows = usable(embeddings.where(F.col("label").isNotNull()), "label")
    moved = (F.col("label") + 1) % 10
    return rows.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")).cast("int").alias("label"),
        F.transform("embedding", lambda c: F.floor(c * 256).cast("double")).alias("x"),
    )


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in an order where each follows its parent (a path at a time), the parent's place in it (-1: none), the distance to it."""
    n = len(points)
    norms = (points**2).sum(axis=1)
    parent, best = np.full(n, -1), np.full(n, np.inf)
    out, joined = np.zeros(n, dtype=bool), []
    at = 0
    for _ in range(n):
        out[at] = True
        joined.append(at)
        apart = np.maximum(norms + norms[at] - 2 * (points @ points[at]), 0)
        nearer = ~out & (apart < best)
        best[nearer], parent[nearer] = apart[nearer], at
        at = int(np.where(out, np.inf, best).argmin())
    children = [[] for _ in range(n)]
    for i in joined[1:]:
        children[parent[i]].append(i)
    order, stack = [], [0] if n else []
    while stack:
        i = stack.pop()
        order.append(i)
        stack += children[i]
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    up = np.array([place[parent[i]] if parent[i] >= 0 else -1 for i in order], dtype=np.int64)
    edge = np.array([np.sqrt(((points[i] - points[parent[i]]) ** 2).sum()) if parent[i] >= 0 else 0.0 for i in order])
    return np.array(order, dtype=np.int64), up, edge


@dataclass
class Block:
    """The anchors of a tree, in its order."""

    vec_id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    parent: np.ndarray
    edge: np.ndarray

    def children(self) -> np.ndarray:
        return np.bincount(self.parent[1:], minlength=len(self.parent))


@dataclass
class Chunk:
    vec_id: np.ndarray
    label: np.ndarray
    x: np.ndarray


def scores(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    if len(x) and np.abs(x).max() * np.abs(anchor).max() * len(anchor) < BIG:
        return (x @ anchor).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, anchor)) for row in x]
    return np.array([min(max(s, -(2**63) + 1), 2**63 - 1) for s in whole], dtype=np.int64)


def visit(block: Block, chunk: Chunk, wanted: Callable, take: Callable) -> int:
    """Goes down the tree with the bounds of a chunk's scores; how many products it took.

    wanted(j, low, high) says which candidates may matter to anchor j by their bounds, and take(j, places, scores)
    gets the exact scores of those.
    """
    norm = np.sqrt((chunk.x**2).sum(axis=1)) * (1 + 1e-9)
    left, bounds, count = block.children(), {}, 0
    for j, (parent, edge) in enumerate(zip(block.parent, block.edge)):
        if parent < 0:
            low, high = np.full(len(norm), -np.inf), np.full(len(norm), np.inf)
            some = np.arange(len(norm))
        else:
            reach = norm * (edge * (1 + 1e-9)) + 1e-3
            low, high = bounds[parent]
            left[parent] -= 1
            if not left[parent]:
                del bounds[parent]
            low, high = low - reach, high + reach
            some = np.flatnonzero(wanted(j, low, high))
        exact = scores(chunk.x if len(some) == len(norm) else chunk.x[some], block.x[j])
        count += len(some)
        low[some] = high[some] = exact
        if left[j]:
            bounds[j] = low, high
        if parent < 0:
            own = wanted(j, low, high)
            some, exact = some[own], exact[own]
        if len(some):
            take(j, some, exact)
    return count


class Best:
    """The few best (score, vec_id) of some lists; equal scores by the lesser vec_id."""

    def __init__(self, lists: int, most: int):
        self.score = np.full((lists, most), np.iinfo(np.int64).min)
        self.vec_id = np.full((lists, most), NO_ID)
        self.filled = np.zeros(lists, dtype=np.int64)

    def weakest(self, i: int) -> float:
        """What a score must reach to enter."""
        return float(self.score[i, -1]) if self.filled[i] == self.score.shape[1] else -np.inf

    def add(self, i: int, score: np.ndarray, vec_id: np.ndarray) -> None:
        n, most = self.filled[i], self.score.shape[1]
        if len(score) > 4 * most:
            # Enough of them to hold the best, ties with the last one included.
            cut = np.partition(score, len(score) - most)[len(score) - most]
            few = np.flatnonzero(score >= cut)
            score, vec_id = score[few], vec_id[few]
        score, vec_id = np.concatenate([self.score[i, :n], score]), np.concatenate([self.vec_id[i, :n], vec_id])
        order = np.lexsort((vec_id, -score))[:most]
        self.filled[i] = len(order)
        self.score[i, : len(order)], self.vec_id[i, : len(order)] = score[order], vec_id[order]

    def rows(self) -> pa.RecordBatch:
        lists = np.repeat(np.arange(len(self.filled)), self.filled)
        inside = np.arange(self.score.shape[1])[None, :] < self.filled[:, None]
        ids = self.vec_id[inside]
        return pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(self.score[inside]), pa.array(ids, mask=ids == NO_ID)], ["list", "score", "vec_id"])


_LISTS = "list int, score bigint, vec_id bigint"


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
        size = len(flat) // max(batch.num_rows, 1)
        ids = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        each = max(1, CHUNK // max(size, 1))
        for at in range(0, batch.num_rows, each):
            yield Chunk(ids[at : at + each], labels[at : at + each], flat[at * size : (at + each) * size].reshape(-1, size))


def find_positives(block: Block, rows: Iterator[Chunk], most: int) -> tuple[Best, int]:
    best, count = Best(len(block.vec_id), most), 0
    for chunk in rows:

        def wanted(j, low, high):
            return (chunk.label == block.label[j]) & (chunk.vec_id != block.vec_id[j]) & (high >= best.weakest(j))

        count += visit(block, chunk, wanted, lambda j, some, exact: best.add(j, exact, chunk.vec_id[some]))
    return best, count


def find_negatives(block: Block, windows: np.ndarray, starts: np.ndarray, rows: Iterator[Chunk], most: int, least: int) -> tuple[Best, int]:
    """windows: the positives' different scores, those of anchor j from starts[j] to starts[j + 1]."""
    best, count = Best(len(windows), most), 0
    lowest = [-(-least * int(p) // 100) for p in windows]
    for chunk in rows:

        def wanted(j, low, high):
            near = np.zeros(len(low), dtype=bool)
            for w in range(starts[j], starts[j + 1]):
                near |= (high >= max(lowest[w], best.weakest(w))) & (low <= windows[w])
            return near & (chunk.label != block.label[j])

        def take(j, some, exact):
            for w in range(starts[j], starts[j + 1]):
                fits = np.flatnonzero((exact >= max(lowest[w], best.weakest(w))) & (exact <= windows[w]))
                if len(fits):
                    best.add(w, exact[fits], chunk.vec_id[some[fits]])

        count += visit(block, chunk, wanted, take)
    return best, count


_TREE = "block int, place int, parent int, edge double, vec_id bigint, label int, x array<double>"


def _tree(key: tuple, anchors: pd.DataFrame) -> pd.DataFrame:
    anchors = anchors.sort_values("anchor").reset_index(drop=True)
    order, parent, edge = spanning_tree(np.stack(anchors["x"].to_list()))
    own = anchors.loc[order, ["vec_id", "label", "x"]].reset_index(drop=True)
    return pd.concat([pd.DataFrame({"block": int(key[0]), "place": np.arange(len(own)), "parent": parent, "edge": edge}), own], axis=1)


def _load(trees: DataFrame, number: int) -> Block:
    """One block, of bounded size, on the driver."""
    got = trees.where(F.col("block") == number).drop("block").toArrow().sort_by("place")
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)
    columns = [got[c].to_numpy() for c in ("vec_id", "label", "parent", "edge")]
    return Block(columns[0], columns[1], x, *columns[2:])


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of all tasks' lists, with their rank."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. Of a positive the first ``negatives`` rows of another
    label are taken whose score is from ``least`` percent of the positive's up to the positive's.
    """
    spark = embeddings.sparkSession
    rows = stored(prepared(embeddings))
    # The identifiers are fixed by writing them.
    anchors = stored(rows.where(F.col("vec_id") % every == 0).withColumn("anchor", F.monotonically_increasing_id()))
    blocks = -(-anchors.count() // BLOCK)
    out = shared_folder(spark)
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(max(blocks, 1))).cast("int"))
    trees = stored(dealt.groupBy("block").applyInPandas(_tree, _TREE))
    drop(anchors)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    for number in range(blocks):
        block = _load(trees, number)
        if not len(block.vec_id):
            continue
        held = spark.sparkContext.broadcast(block)

        def first(batches):
            best, _ = find_positives(held.value, chunks(batches), positives)
            yield best.rows()

        own = stored(_ranked(rows.mapInArrow(first, _LISTS), positives))
        # At most ``positives`` different scores for each anchor of the block.
        scored = own.select("list", "score").distinct().toArrow()
        at, windows = scored["list"].to_numpy(), scored["score"].to_numpy()
        order = np.lexsort((windows, at))
        at, windows = at[order], windows[order]
        starts = np.searchsorted(at, np.arange(len(block.vec_id) + 1))
        limits = spark.sparkContext.broadcast((windows, starts))

        def second(batches):
            best, _ = find_negatives(held.value, *limits.value, chunks(batches), negatives, least)
            yield best.rows()

        near = _ranked(rows.mapInArrow(second, _LISTS), negatives)
        names = pa.table({"list": np.arange(len(windows), dtype=np.int32), "place": at.astype(np.int32), "positive_score": windows, "anchor_id": block.vec_id[at]})
        window = spark.createDataFrame(names.to_pandas()) if len(windows) else None
        if window is not None:
            pairs = own.select(F.col("list").alias("place"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
            joined = near.join(window, "list").join(pairs, ["place", "positive_score"])
            columns = ["anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
            joined.select(*columns).write.mode("append").parquet(out)
        drop(own)
        held.unpersist()
        limits.unpersist()
    drop(trees)
    drop(rows)
    return spark.read.schema(schema).parquet(out)
