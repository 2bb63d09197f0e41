"""Jaccard self-join of documents on word shingles, by a grouped prefix join.

A document is the set of hashes of its ``SIZE``-word shingles. Sets are ordered by one order of
all shingles: those of many documents last, else by hash. Two sets that reach
the threshold share a shingle among the first n - ceil(0.8 n) + 1 of either. Steps:

1. Count the shingles that may be in a prefix; the frequent ones go into a
   bitmap of fixed size. Any bitmap gives a valid order, so chance hits in it cost time only.
2. Documents with the same prefix and set size are one group. The prefixes of groups
   are inverted; shingles of a single group are done with.
3. Each list links its groups to its least group. Group pairs pass the length and
   position filters, are expanded to different sets, and verified on whole sets. Before
   whole sets are moved, parity bitmaps rule out pairs that differ in too many shingles.
4. Of lists that are not yet within one component, the groups outside
   the list's largest component are paired with those of other components. This happens inside tasks, a pair of
   blocks of a list at a time: group pairs are filtered by length and position, those left are expanded to
   their sets, and only sets whose folded parity bitmaps leave room come out, to be verified in the same way. Sets already in one component need no link
   between them, so no group's pairs are all emitted, yet no component is missed.

Equal sets are one throughout. Null and texts without words have an empty set and
are linked with nothing. Extra columns are ignored; repeated rows are equal
sets. A repeated doc_id is one node with all its texts, as a component is one of documents; ``one_of_each`` goes by
texts. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bits import bitmap_of, in_bitmap
from .components import components
from .store import drop, free_shuffles, stored
from .words import NOT_BLANK, shingles, slices, words_of

SIZE = 5
PERCENT = 80  # 100 * intersection >= PERCENT * union
BLOCK = 4096  # sets of a list that meet as many others in a task
FOLDED = 1024  # bits of a parity bitmap there
PAIRS = 1 << 17  # compared at once
SET_BYTES = 1 << 18  # of text whose words a task holds at once, unless one text has more
POSTED = 1000  # groups whose prefixes it takes apart at once
FREQUENT = 64  # a shingle in the prefixes of more documents goes to the end of the order


def _prefix_length(n: int) -> int:
    return n - -(-n * PERCENT // 100) + 1


def _sets(texts: pa.Array):
    """(index, sorted distinct shingle hashes as uint64) of every text."""
    for at, data, bounds in slices(texts, SET_BYTES):
        hashes, cuts = shingles(words_of(data, bounds, NOT_BLANK), SIZE)
        for i in range(len(cuts) - 1):
            own = np.sort(hashes[cuts[i] : cuts[i + 1]])
            if len(own) > 1:
                own = own[np.append(True, own[1:] != own[:-1])]
            yield at + i, own


def _frequent(docs: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the shingles that are in the hash-order prefix of many documents."""

    def run(batches):
        for batch in batches:
            held = [own[: _prefix_length(len(own))] for _, own in _sets(batch.column("text")) if len(own)]
            if held:
                token, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int32))], ["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token bigint, n int").groupBy("token").agg(F.sum("n").alias("n"))
    return bitmap_of(counts.where(F.col("n") > FREQUENT), "token", bits)


def _parity(own: np.ndarray) -> bytes:
    """A bitmap of 2 to 4 bits a shingle: a bit is set where an odd number of shingles fall.

    Two sets differ in at least as many shingles as their bitmaps differ in bits. A
    bitmap is folded to half its size by XOR of its halves.
    """
    size = max(FOLDED, 1 << (2 * len(own) - 1).bit_length())
    at = (own & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1, bitorder="little").tobytes()


def _signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, digest and parity bitmap of the set, and the group: digest of prefix and size, with the prefix itself."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        late = held.value
        for batch in batches:
            sizes, digests, parities, groups, prefixes = [], [], [], [], []
            for _, own in _sets(batch.column("text")):
                n = len(own)
                sizes.append(n)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                parities.append(_parity(own) if n else None)
                last = in_bitmap(late, own)
                ordered = np.concatenate([own[~last], own[last]]) if last.any() else own
                prefix = ordered[: _prefix_length(n)].tobytes() if n else b""
                groups.append(hashlib.blake2b(prefix + n.to_bytes(8, "little"), digest_size=16).digest() if n else None)
                prefixes.append(prefix)
            if sizes:
                arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64())]
                arrays += [pa.array(x, pa.binary()) for x in (digests, parities, groups, prefixes)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "digest", "parity", "grp", "prefix"])

    schema = "doc_id bigint, n bigint, digest binary, parity binary, grp binary, prefix binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _postings(groups: DataFrame) -> DataFrame:
    """token, id of the group, its set size and the token's place in the prefix."""

    def run(batches):
        for batch in (b.slice(i, POSTED) for b in batches for i in range(0, b.num_rows, POSTED)):
            tokens = [np.frombuffer(p, dtype=np.int64) for p in batch.column("prefix").to_pylist()]
            each = np.array([len(t) for t in tokens], dtype=np.int64)
            if not each.sum():
                continue
            repeat = np.repeat(np.arange(len(each)), each)
            place = np.arange(len(repeat)) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens)),
                    batch.column("g").take(pa.array(repeat)),
                    batch.column("n").take(pa.array(repeat)),
                    pa.array(place.astype(np.int32)),
                ],
                ["token", "g", "n", "place"],
            )

    return groups.select("g", "n", "prefix").mapInArrow(run, "token bigint, g bigint, n bigint, place int")


def _fits(n1, place1, n2, place2):
    """The length filter, and whether enough shingles remain from the shared one on."""
    small, large = F.least(n1, n2), F.greatest(n1, n2)
    rest = F.least(n1 - place1, n2 - place2)
    return (small * 100 >= large * PERCENT) & (rest * (100 + PERCENT) >= (n1 + n2) * PERCENT)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (u, v) of sets, those that reach the threshold."""
    first = pairs.join(sets.select(F.col("r").alias("u"), F.col("items").alias("a")), "u")
    second = first.join(sets.select(F.col("r").alias("v"), F.col("items").alias("b")), "v")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return second.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _sets_of(docs: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """r and ``items``, the whole set, of the rows whose doc_id is in a pair, and of a few by chance."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("r"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(F.xxhash64("r").alias("h")), "h", bits))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(held.value, batch.column("h").to_numpy().view(np.uint64))))
            items = [own.tobytes() for _, own in _sets(batch.column("text"))]
            if items:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(items, pa.binary())], ["r", "items"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    return rows.mapInArrow(run, "r bigint, items binary")


def _differing(a: bytes, b: bytes) -> int:
    """The bits in which two parity bitmaps differ, the larger folded to the size of the smaller."""
    a, b = sorted((np.frombuffer(x, dtype=np.uint64) for x in (a, b)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _plausible(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs whose parity bitmaps leave room for the threshold.

    Sets of n1 and n2 shingles that differ in d of them share (n1 + n2 - d) / 2.
    """
    first = pairs.join(heads.select(F.col("r").alias("u"), F.col("n").alias("n1"), F.col("parity").alias("a")), "u")
    both = first.join(heads.select(F.col("r").alias("v"), F.col("n").alias("n2"), F.col("parity").alias("b")), "v")

    def run(batches):
        for batch in batches:
            differ = [_differing(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            total = batch.column("n1").to_numpy() + batch.column("n2").to_numpy()
            most = (total - np.array(differ, dtype=np.int64)) // 2
            keep = pa.array(most * (100 + PERCENT) >= total * PERCENT)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(keep)

    return both.select("u", "v", "a", "b", "n1", "n2").mapInArrow(run, "u bigint, v bigint").distinct()


def _linked(docs: DataFrame, pairs: DataFrame, signed: DataFrame, bits: int) -> DataFrame:
    """The pairs of sets that reach the threshold: filtered by parity bitmaps, then verified on whole sets."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("r")).distinct()
    rows = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL").select(F.col("doc_id").alias("r"), "n", "parity")
    heads = stored(rows.join(ends, "r", "left_semi").distinct())
    left = stored(_plausible(pairs, heads))
    free_shuffles(docs.sparkSession)
    drop(heads)
    sets = stored(_sets_of(docs, left, bits))
    links = stored(_verified(left, sets))
    free_shuffles(docs.sparkSession)
    drop(sets)
    return links


def _classes(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, n_shingles and the component ``c`` of every row, where a doc_id has one text only (null: any)."""
    spark = docs.sparkSession
    frequent = _frequent(docs, bits)
    whole = stored(_signatures(docs, frequent))
    free_shuffles(spark)
    signed = stored(whole.drop("prefix"))
    nodes = stored(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("r"), F.first("n").alias("n"), F.first("grp").alias("grp")))
    # Groups are known by the least doc_id in them.
    groups = whole.where("grp IS NOT NULL").groupBy("grp").agg(F.min("doc_id").alias("g"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    groups = stored(groups.where("g IS NOT NULL").drop("grp"))
    free_shuffles(spark)
    drop(whole)
    # Of lists, those with more than one group are left.
    per_token = Window.partitionBy("token")
    lists = _postings(groups).withColumn("hub", F.min(F.struct("g", "n", "place")).over(per_token))
    shared = stored(lists.withColumn("_most", F.max("g").over(per_token)).where(F.col("_most") > F.col("hub.g")).drop("_most"))
    free_shuffles(spark)
    drop(groups)

    # Members: the different sets of each group, known by their least doc_id.
    members = nodes.where("r IS NOT NULL").select("grp", "r", "digest")
    group_ids = members.groupBy("grp").agg(F.min("r").alias("g"), F.count("*").alias("sets"))
    members = stored(members.join(group_ids, "grp").select("g", "r", "digest", "sets"))
    inner = members.where("r <> g").select(F.col("g").alias("u"), F.col("r").alias("v"))
    outer = shared.where(
        (F.col("g") != F.col("hub.g")) & _fits(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place"))
    ).select(F.col("hub.g").alias("u"), F.col("g").alias("v"))
    links = _linked(docs, stored(inner.union(outer).distinct()), signed, bits)

    found = components(links)
    at = stored(members.join(found.withColumnRenamed("node", "r"), "r", "left").select("g", "r", F.coalesce("component", "r").alias("c"), "sets"))
    mixed = stored(_mixed(shared, at))
    free_shuffles(spark)
    drop(shared)
    crossing = stored(_crossing(mixed, signed))
    free_shuffles(spark)
    drop(mixed)
    found = stored(components(links.union(_linked(docs, crossing, signed, bits))))

    by_digest = nodes.join(found.withColumnRenamed("node", "r"), "r", "left").select(
        F.col("digest").alias("_digest"), F.coalesce("component", "r").alias("_c")
    )
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    return rows.join(by_digest, rows["digest"] == F.col("_digest"), "left").select(
        "doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("c")
    )


def _mixed(shared: DataFrame, at: DataFrame) -> DataFrame:
    """The lists whose sets are of several components, a row for each set, with the list's largest component ``main``."""
    # A group with several sets is a list of its own: their prefixes are the same.
    lists = shared.select(F.col("token"), F.lit(0).alias("kind"), "g", "n", "place").join(at, "g")
    own = at.where("sets > 1").select(
        F.col("g").alias("token"), F.lit(1).alias("kind"), "g", F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("place"), "r", "c"
    )
    rows = lists.select("token", "kind", "g", "n", "place", "r", "c").union(own)
    counted = rows.groupBy("token", "kind", "c").agg(F.count("*").alias("k"))
    mixed = counted.groupBy("token", "kind").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count("*").alias("parts"))
    return rows.join(mixed.where("parts > 1").drop("parts"), ["token", "kind"])


def _folded(parity: bytes) -> bytes:
    """A parity bitmap folded to ``FOLDED`` bits."""
    whole = np.frombuffer(parity, dtype=np.uint64)
    while len(whole) * 64 > FOLDED:
        whole = whole[: len(whole) // 2] ^ whole[len(whole) // 2 :]
    return whole.tobytes()


def _runs(lengths: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers begins[i], begins[i] + 1 and so on, ``lengths[i]`` of them, with the i they belong to."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + begins[of]


def _pieces(weights: np.ndarray):
    """Slices of a list whose weights add up to about ``PAIRS`` each."""
    total = np.cumsum(weights)
    cuts = np.searchsorted(total, np.arange(PAIRS, (total[-1] if len(total) else 0) + PAIRS, PAIRS))
    edges = np.unique(np.concatenate([[0], cuts + 1, [len(weights)]]).clip(0, len(weights)))
    yield from zip(edges[:-1], edges[1:])


def _survivors(key: np.ndarray, rows: dict[str, np.ndarray], parity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of one key (a list, or two blocks of one) that may reach the threshold and cross components.

    Sets of a group are equal in size and place: the length and position filters see pairs of groups, and only those that
    pass are expanded to sets and compared by their bitmaps. Groups within the key's main component are met from outside only.
    """
    order = np.lexsort((rows["g"], key))
    key, parity, rows = key[order], parity[order], {x: v[order] for x, v in rows.items()}
    c, r, size = rows["c"], rows["r"], rows["size"]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (rows["g"][1:] != rows["g"][:-1])])) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(new, len(key)))
    outside = np.add.reduceat((c != rows["main"]).astype(np.int64), new) > 0 if len(new) else np.zeros(0, dtype=bool)
    # In a key, groups with sets outside the main component come first; each meets itself and those after it.
    by = np.lexsort((~outside, key[new]))
    begin, count, outside, own = new[by], count[by], outside[by], key[new][by]
    n, place = rows["n"][begin], rows["place"][begin]
    end = np.searchsorted(own, own, side="right")
    live = np.flatnonzero(outside)
    us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for low, high in _pieces(end[live] - live):
        a = live[low:high]
        of, second = _runs(end[a] - a, a)
        first = a[of]
        small, large = np.minimum(n[first], n[second]), np.maximum(n[first], n[second])
        rest = np.minimum(n[first] - place[first], n[second] - place[second])
        near = (small * 100 >= large * PERCENT) & (rest * (100 + PERCENT) >= (n[first] + n[second]) * PERCENT)
        near &= (first != second) | (count[first] > 1)
        first, second = first[near], second[near]
        # A set of the first group with all sets of the second is the unit from here on.
        of, left = _runs(count[first], begin[first])
        second = second[of]
        for start, stop in _pieces(count[second]):
            some = second[start:stop]
            of, y = _runs(count[some], begin[some])
            x = left[start:stop][of]
            fits = np.flatnonzero((c[x] != c[y]) & ((rows["whole"][x] == 1) | (rows["side"][x] != rows["side"][y])))
            x, y = x[fits], y[fits]
            differ = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
            total = size[x] + size[y]
            fits = (total - differ) // 2 * (100 + PERCENT) >= total * PERCENT
            us.append(np.minimum(r[x], r[y])[fits])
            vs.append(np.maximum(r[x], r[y])[fits])
    pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
    return pairs[0], pairs[1]


def _crossing(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets of different components that share a list, of those that pass all filters.

    A list of more than ``BLOCK`` sets is cut into blocks by hash, and each pair of blocks is a unit of work of its
    own, so a task holds two blocks at most. The pairs of a block pair are looked at in place.
    """
    heads = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL").select(F.col("doc_id").alias("r"), F.col("n").alias("size"), "parity")
    heads = heads.join(rows.select("r").distinct(), "r", "left_semi").distinct()

    def fold(batches):
        for batch in batches:
            short = [_folded(p) for p in batch.column("parity").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("r"), batch.column("size"), pa.array(short, pa.binary())], ["r", "size", "parity"])

    heads = heads.mapInArrow(fold, "r bigint, size bigint, parity binary")
    large = rows.groupBy("token", "kind").count().where(F.col("count") > BLOCK)
    cut = rows.join(large, ["token", "kind"], "left").withColumn("blocks", F.ceil(F.coalesce("count", F.lit(1)) / F.lit(BLOCK)).cast("int"))
    own = F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = cut.withColumn("own", own).select("*", met.alias("with")).drop("count", "blocks").join(heads, "r")
    dealt = dealt.withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with"), "side": (F.col("own") > F.col("with")).cast("int")})
    key = ["token", "kind", "lo", "hi"]
    dealt = dealt.withColumn("whole", (F.col("lo") == F.col("hi")).cast("int"))
    columns = ["g", "n", "place", "r", "c", "main", "size", "side", "whole"]
    sorted_ = dealt.select(*key, *columns, "parity").repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([held[x].to_numpy().astype(np.int64) for x in key])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                # The last key may go on in the next batch.
                yield pairs_of(held.slice(0, cuts[-1]), keys[:, : cuts[-1]], cuts[:-1])
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield pairs_of(held, np.zeros((1, held.num_rows)), np.zeros(0, dtype=np.int64))

    def pairs_of(rows, keys, cuts):
        number = np.zeros(keys.shape[1], dtype=np.int64)
        number[cuts] = 1
        parity = np.frombuffer(b"".join(rows["parity"].to_pylist()), dtype=np.uint64).reshape(rows.num_rows, -1)
        u, v = _survivors(np.cumsum(number), {x: rows[x].to_numpy().astype(np.int64) for x in columns}, parity)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return sorted_.mapInArrow(run, "u bigint, v bigint").distinct()


def _several(docs: DataFrame) -> DataFrame | None:
    """The doc_ids that have several texts, null among them where it occurs; None if there is none."""
    seen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"))
    found = seen.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b OR doc_id IS NULL")
    found = stored(found.select("doc_id"))
    return None if found.isEmpty() else found


def _tagged(docs: DataFrame, several: DataFrame | None, unit: str) -> DataFrame:
    """The rows with a number that has one text: the doc_id, or where that is null or has several texts a negative one for each."""
    number = F.col("doc_id").cast("bigint")
    if several is None:
        return docs.withColumn(unit, number)
    names = [docs[f"`{c}`"] for c in docs.columns]
    marks = several.select(F.col("doc_id").alias(f"{unit}_id"), F.lit(True).alias(f"{unit}_own"))
    own = -1 - F.xxhash64(number, F.col("text")).bitwiseAND(F.lit((1 << 63) - 1))
    marked = docs.join(marks, docs["doc_id"].cast("bigint") == marks[f"{unit}_id"], "left")
    tag = F.when(docs["doc_id"].isNull() | F.col(f"{unit}_own"), own).otherwise(docs["doc_id"].cast("bigint"))
    return marked.select(*names, tag.alias(unit))


def _unused(docs: DataFrame, name: str) -> str:
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def near_duplicates(docs: DataFrame, bits: int = 23) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, one row per row of ``docs``.

    component_id is the smallest doc_id reachable by links, through any of a document's texts where it has several; a
    document without links or words is its own component. Rows without doc_id are documents each for its text; a
    component of such rows alone has a null component_id.
    """
    docs = docs.select("doc_id", "text")
    several = _several(docs)
    tagged = _tagged(docs, several, "unit")
    rows = _classes(tagged.select(F.col("unit").alias("doc_id"), "text"), bits)
    if several is None:
        return rows.withColumnRenamed("c", "component_id")
    rows = stored(rows.select(F.col("doc_id").alias("unit"), "n_shingles", "c"))
    units = stored(tagged.where("unit < 0").select("unit", F.col("doc_id").cast("bigint").alias("doc_id")).distinct())
    named = rows.join(units, "unit", "left").select(
        F.when(F.col("unit") >= 0, F.col("unit")).otherwise(F.col("doc_id")).alias("doc_id"), "n_shingles", "unit", "c"
    )
    # The texts of a document are one node, which may join their components.
    tied = components(named.where("unit < 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("u"), F.col("c").alias("v")))
    at = named.join(tied.withColumnRenamed("node", "c"), "c", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "c").alias("c")
    )
    least = at.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return at.join(least, "c").select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of equal or similar texts, that of the smallest doc_id; all columns stay as they are.

    A doc_id with several texts is one document for each of them here, and so is a row without doc_id, so no text goes
    without a similar one that stays. Of rows with the same doc_id and text one stays. Texts without words all stay.
    """
    unit, names = _unused(docs, "unit"), docs.columns
    several = _several(docs)
    tagged = _tagged(docs, several, unit)
    rows = _classes(tagged.select(F.col(unit).alias("doc_id"), "text"), 23)
    rows = stored(rows.select(F.col("doc_id").alias(unit), "n_shingles", "c"))
    gone = rows.where(F.col(unit) != F.col("c")).select(unit)
    if several is not None:
        # A number of its own says nothing of the doc_id's place.
        units = tagged.where(F.col(unit) < 0).select(unit, F.col("doc_id").cast("bigint").alias("_id")).distinct()
        named = rows.join(stored(units), unit, "left").withColumn("_id", F.when(F.col(unit) >= 0, F.col(unit)).otherwise(F.col("_id")))
        first = F.min(F.struct(F.col("_id").isNull(), "_id", unit)).alias("first")
        kept = named.groupBy("c").agg(first).select(F.col(f"first.{unit}").alias(unit))
        gone = rows.select(unit).join(kept, unit, "left_anti")
    stay = tagged.join(stored(gone.distinct()), unit, "left_anti")
    repeated = stored(rows.where("n_shingles > 0").groupBy(unit).count().where("count > 1").select(unit))
    if not repeated.isEmpty():
        order = Window.partitionBy(unit).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
        again = stay.join(repeated, unit, "left_semi").withColumn(f"{unit}_place", F.row_number().over(order))
        once = again.where(F.col(f"{unit}_place") == 1).drop(f"{unit}_place")
        stay = stay.join(repeated, unit, "left_anti").unionByName(once)
    return stay.select(*[F.col(f"`{c}`") for c in names])
