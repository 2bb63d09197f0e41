"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of every word of the training documents. The
index is made of segments, each over about ``SEGMENT_WORDS`` words of whole
documents: a sorted term dictionary, and for each term the sorted positions in the segment.
``search`` intersects, within each segment, the offset-adjusted posting lists of
a benchmark window, from its rarest term on, and returns exact phrases and
proximity matches with their positions. Segments are searched where they lie, so
nothing is shuffled but the matches. The benchmark is sent to the tasks in blocks
of bounded size, each of them against all segments.

Null and texts without words have no postings and match nothing. Extra columns
are ignored. Repeated rows are indexed and reported each on its own. A benchmark
item given twice counts once per document; an item of null id is searched,
but not listed. Words and terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import drop, shared_folder, stored
from .words import ALNUM, Words, slices, words_of

WINDOW = 10
SEGMENT_WORDS = 1 << 20
TEXT_BYTES = 1 << 18  # whose words are hashed at once, unless one text has more
BLOCK_WORDS = 200_000  # of the benchmark, sent to all tasks at a time
CANDIDATES = 1 << 20  # intersected at a time
SLOP = 3

INDEX_SCHEMA = (
    "segment bigint, doc_ids array<bigint>, text_hashes array<bigint>, doc_words binary, "
    "n_words bigint, terms binary, term_counts binary, postings binary"
)


def _words(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words) of a few texts at a time."""
    for at, data, bounds in slices(texts, TEXT_BYTES):
        yield at, words_of(data, bounds, ALNUM)


def _segment(number: int, ids: list, marks: list, counts: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    words = np.concatenate(hashes)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    terms = ordered[new]
    rank = np.cumsum(new) - 1
    # A posting is rank x words of the segment + position: one ascending array for all lists.
    keys = rank.astype(np.int64) * len(words) + order
    steps = np.diff(keys, prepend=0).astype(np.uint32)
    each = np.bincount(rank, minlength=len(terms)).astype(np.uint32)
    row = [number, [i for part in ids for i in part], [m for part in marks for m in part]]
    row += [np.concatenate(counts).astype(np.uint32).tobytes(), len(words), terms.tobytes(), each.tobytes(), steps.tobytes()]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()] + [pa.binary()] * 3
    names = [part.strip().split(" ")[0] for part in INDEX_SCHEMA.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)


def build_index(docs: DataFrame, words_each: int = SEGMENT_WORDS) -> DataFrame:
    """Store the index of ``doc_id`` and ``text`` in the shared folder; returns its table of segments."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, marks, counts, hashes, held = [], [], [], [], 0
        for batch in batches:
            own, mark = batch.column("doc_id"), batch.column("mark")
            for at, found in _words(batch.column("text")):
                ids.append(own.slice(at, found.texts).to_pylist())
                marks.append(mark.slice(at, found.texts).to_pylist())
                counts.append(found.count())
                hashes.append(found.hash)
                held += len(found.hash)
                if held >= words_each:
                    yield _segment(number, ids, marks, counts, hashes)
                    ids, marks, counts, hashes, held = [], [], [], [], 0
                    number += 1
        if ids:
            yield _segment(number, ids, marks, counts, hashes)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), "text")
    path = shared_folder(docs.sparkSession)
    rows.mapInArrow(run, INDEX_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


def indexed_documents(index: DataFrame) -> DataFrame:
    """A row per indexed document: segment, number in the segment, id, text hash, words."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, marks = batch.column("doc_ids").slice(i, 1).flatten(), batch.column("text_hashes").slice(i, 1).flatten()
                words = np.frombuffer(batch.column("doc_words")[i].as_py(), dtype=np.uint32).astype(np.int64)
                segment = np.full(len(words), batch.column("segment")[i].as_py(), dtype=np.int64)
                numbers = np.arange(len(words), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment), pa.array(numbers), ids, marks, pa.array(words)],
                    ["segment", "doc_no", "doc_id", "text_hash", "n_words"],
                )

    columns = index.select("segment", "doc_ids", "text_hashes", "doc_words")
    return columns.mapInArrow(run, "segment bigint, doc_no bigint, doc_id bigint, text_hash bigint, n_words bigint")


class Block:
    """Windows of some benchmark items, as columns of numbers of the block's terms."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.item_ids = [i for i, _ in items]
        self.terms = np.unique(np.concatenate([h for _, h in items]))
        rows, self.item, self.size = [], [], []
        for number, (_, h) in enumerate(items):
            own = np.searchsorted(self.terms, h).astype(np.int32)
            if len(own) < WINDOW:
                rows.append(np.concatenate([own, np.full(WINDOW - len(own), -1, dtype=np.int32)])[None])
            else:
                rows.append(np.lib.stride_tricks.sliding_window_view(own, WINDOW))
            self.item += [number] * len(rows[-1])
            self.size += [min(len(own), WINDOW)] * len(rows[-1])
        self.windows = np.concatenate(rows)
        self.item, self.size = np.array(self.item), np.array(self.size)
        self.order = None

    def rank_by(self, counts: np.ndarray) -> None:
        """Order the places of each window from its rarest term in the corpus on; ties by place."""
        often = np.where(self.windows >= 0, counts[self.windows], np.iinfo(np.int64).max)
        self.order = np.argsort(often, axis=1, kind="stable").astype(np.int8)


def blocks_of(benchmark: DataFrame) -> list[Block]:
    """The benchmark in blocks of about BLOCK_WORDS words. It is the stated query set, not the corpus."""

    def run(batches):
        for batch in batches:
            for at, found in _words(batch.column("text")):
                own = [found.hash[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(at, len(own)), pa.array(own, pa.binary())], ["item_id", "h"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, h binary").where("length(h) > 0")
    blocks, items, held = [], [], 0
    for row in rows.toLocalIterator():
        items.append((row["item_id"], np.frombuffer(bytes(row["h"]), dtype=np.uint64)))
        held += len(items[-1][1])
        if held >= BLOCK_WORDS:
            blocks.append(Block(items))
            items, held = [], 0
    return blocks + ([Block(items)] if items else [])


def _frequencies(index: DataFrame, block: Block) -> np.ndarray:
    """Corpus counts of the block's terms, from the dictionaries of all segments."""
    wanted = block.terms

    def run(batches):
        for batch in batches:
            total = np.zeros(len(wanted), dtype=np.int64)
            for i in range(batch.num_rows):
                terms = np.frombuffer(batch.column("terms")[i].as_py(), dtype=np.uint64)
                counts = np.frombuffer(batch.column("term_counts")[i].as_py(), dtype=np.uint32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    total += np.where(terms[at] == wanted, counts[at], 0)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "n"])

    rows = index.select("terms", "term_counts").mapInArrow(run, "t bigint, n bigint")
    got = rows.groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(wanted), dtype=np.int64)
    out[got["t"].to_numpy()] = got["n"].to_numpy()
    return out


def _intersect(block: Block, length: int, terms, counts, keys, doc_starts, slop: int):
    """(window, start, exact) of the matches in a segment of ``length`` words."""
    at = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
    rank = np.where(terms[at] == block.terms, at, -1)
    place = np.where(block.windows >= 0, rank[block.windows], 0)
    windows = np.flatnonzero((place >= 0).all(axis=1))
    starts_of = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    anchor = rank[block.windows[windows, block.order[windows, 0]]]
    todo = starts_of[anchor + 1] - starts_of[anchor]
    cut = np.concatenate([[0], np.cumsum(todo)])
    low = 0
    while low < len(windows):
        high = max(int(np.searchsorted(cut, cut[low] + CANDIDATES, side="right")) - 1, low + 1)
        part = windows[low:high]
        n = todo[low:high]
        w = np.repeat(part, n)
        within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        key = keys[np.repeat(starts_of[anchor[low:high]], n) + within]
        place_of = key - np.repeat(anchor[low:high], n) * length
        start = place_of - block.order[w, 0]
        low = high
        doc = np.searchsorted(doc_starts, place_of, side="right") - 1
        size = block.size[w]
        exact = (start >= doc_starts[doc]) & (start + size <= doc_starts[doc + 1])
        # Words may stand up to slop nearer than in the window, so a near match may seem to pass the ends of its text.
        fits = (start >= doc_starts[doc] - slop) & (start + size <= doc_starts[doc + 1] + slop)
        w, start, doc, exact = w[fits], start[fits], doc[fits], exact[fits]
        for j in range(1, WINDOW):
            if not len(w):
                break
            col = block.order[w, j].astype(np.int64)
            live = block.windows[w, col] >= 0
            r = rank[block.windows[w, col]]
            goal = r * length + start + col
            found = np.minimum(np.searchsorted(keys, goal), len(keys) - 1)
            hit = ~live | (keys[found] == goal)
            if slop:
                first = r * length + np.maximum(start + col - slop, doc_starts[doc])
                last = r * length + np.minimum(start + col + slop, doc_starts[doc + 1] - 1)
                near = ~live | (np.searchsorted(keys, first) < np.searchsorted(keys, last, side="right"))
            else:
                near = hit & exact
            exact &= hit
            w, start, doc, exact = w[near], start[near], doc[near], exact[near]
        yield w, start, doc, exact


def search(index: DataFrame, benchmark: DataFrame, slop: int = 0) -> DataFrame:
    """Matches: segment, doc_no, item_id, begin and end (words of the document, end exclusive), kind.

    ``phrase``: the words of a window, consecutive; overlapping windows of an
    item are one match. ``near`` (with slop > 0): the rarest term of a window, and every
    other within ``slop`` words of its place beside it, but not as a phrase.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"segment bigint, doc_no bigint, item_id {kind}, begin bigint, end bigint, kind string"
    out = None
    for block in blocks_of(benchmark):
        block.rank_by(_frequencies(index, block))
        held = index.sparkSession.sparkContext.broadcast(block)
        columns = index.select("segment", "doc_words", "n_words", "terms", "term_counts", "postings")
        found = columns.mapInArrow(_searcher(held, slop), schema)
        out = found if out is None else out.unionAll(found)
    return index.sparkSession.createDataFrame([], schema) if out is None else out


def _searcher(held, slop):
    def run(batches):
        block = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), dtype=kind)
                terms, counts = get("terms", np.uint64), get("term_counts", np.uint32)
                if not len(terms):
                    continue
                length = batch.column("n_words")[i].as_py()
                keys = np.cumsum(get("postings", np.uint32), dtype=np.int64)
                doc_starts = np.concatenate([[0], np.cumsum(get("doc_words", np.uint32), dtype=np.int64)])
                parts = list(_intersect(block, length, terms, counts, keys, doc_starts, slop))
                if not parts:
                    continue
                w, start, doc, exact = (np.concatenate(x) for x in zip(*parts))
                item = block.item[w]
                order = np.lexsort((start, item, doc, ~exact))
                w, start, doc, exact, item = w[order], start[order], doc[order], exact[order], item[order]
                if not len(w):
                    continue
                end = start + block.size[w]
                # Overlapping windows of one item are one match. They start in ascending order and have the same size.
                fresh = np.ones(len(w), dtype=bool)
                same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (exact[1:] == exact[:-1])
                fresh[1:] = ~(same & (start[1:] <= end[:-1]))
                begins = np.flatnonzero(fresh)
                ends = np.append(begins[1:], len(w)) - 1
                base, limit = doc_starts[doc[begins]], doc_starts[doc[begins] + 1]
                segment = np.full(len(begins), batch.column("segment")[i].as_py(), dtype=np.int64)
                names = [block.item_ids[k] for k in item[begins]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment),
                        pa.array(doc[begins].astype(np.int64)),
                        pa.array(names) if any(n is not None for n in names) else pa.array(names, pa.int64()),
                        pa.array((np.maximum(start[begins], base) - base).astype(np.int64)),
                        pa.array((np.minimum(end[ends], limit) - base).astype(np.int64)),
                        pa.array(np.where(exact[begins], "phrase", "near").tolist(), pa.string()),
                    ],
                    ["segment", "doc_no", "item_id", "begin", "end", "kind"],
                )

    return run


def report(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document: words, words hit, items with exact windows, their digest, items only near, verdict."""
    key = ["segment", "doc_no"]
    order = Window.partitionBy(*key).orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    phrases = matches.where("kind = 'phrase'")
    hits = (
        phrases.select(*key, "begin", "end")
        .withColumn("_from", F.greatest(F.col("begin"), F.coalesce(before, F.lit(0))))
        .groupBy(*key)
        .agg(F.sum(F.greatest(F.col("end") - F.col("_from"), F.lit(0))).alias("n_hit"))
    )
    names = matches.groupBy(*key).agg(
        F.collect_set(F.when(F.col("kind") == "phrase", F.col("item_id").cast("string"))).alias("_items"),
        F.collect_set(F.when(F.col("kind") == "near", F.col("item_id").cast("string"))).alias("_near"),
    )
    found = hits.join(names, key, "full")
    none = F.array().cast("array<string>")
    items, near = F.coalesce("_items", none), F.coalesce("_near", none)
    return (
        indexed_documents(index)
        .join(found, key, "left")
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.size(items).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
            F.size(F.array_except(near, items)).cast("bigint").alias("n_near"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an exact window of the benchmark; all columns stay as they are."""
    index = build_index(docs)
    bad = stored(report(index, search(index, benchmark)).where("contaminated").select("doc_id", "text_hash").distinct())
    drop(index)
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")
