"""Token ids in compressed binary segments that give single documents back cheaply.

``write_tokens`` encodes documents in ascending doc_id order and stores, under one path:

- ``segments``: Parquet rows of about ``SEGMENT_BYTES``. A row holds zstandard frames, one
  per document, laid end to end (``payload``), and the index of its documents:
  ids, frame offsets and token counts as little-endian arrays. ``dictionary`` names the
  dictionary by its SHA-256. ``shard`` and ``part`` order the rows; ``before``
  counts the tokens of the shard before the row.
- ``dictionary``: one row with the dictionary all frames share and its hash. It is trained on
  the serialized id arrays of at most ``SAMPLE`` documents, taken by hash; it changes
  the size of the files only.

A document's ids are unsigned 16-bit numbers where the vocabulary allows, else 32-bit; the row says which.
``read_tokens`` gives all documents back, ``read_document`` one, decoding its frame alone.

Null and empty texts have the end id only. A null doc_id comes first. Rows of the same
doc_id follow each other by text. Extra columns are ignored. An
empty table gives an empty ``segments``.
"""

from __future__ import annotations

import hashlib
import string
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import slices

SEGMENT_BYTES = 1 << 20  # of ids before compression
SAMPLE = 400
DICTIONARY_BYTES = 1 << 15
CACHED_WORDS = 300_000  # in each Python worker, and as many older ones
LEVEL = 3

SEGMENT_SCHEMA = (
    "shard int, part int, before bigint, first_id bigint, last_id bigint, n_docs int, n_tokens bigint, width int, "
    "dictionary string, ids binary, id_known binary, offsets binary, counts binary, payload binary"
)


class _Cache(dict):
    """ids of words, learned when first asked for."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: bytes) -> bytes:
        ids = self.owner.older.get(word)
        if ids is None:
            ids = self.owner._learn(word)
        self[word] = ids
        return ids


class Encoder:
    """Encodes texts with the tokenizers library, each different word once.

    For tokenizers that drop white space and split at it, a text's ids are those of its
    words. A text is lower-cased in ASCII first where the tokenizer does so anyway, no
    character is composed differently for it and it has no special token's string.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.cache = _Cache(self)
        self.older: dict[bytes, bytes] = {}
        self.letters: dict[str, str] = {}
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = "Aa bB  cC\n dD"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        split = [i for w in probe.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        self.by_word = whole == split
        self.lower = whole == self.tokenizer.encode(probe.lower(), add_special_tokens=False).ids
        # Plain words go to the model directly if that gives the same ids.
        self.plain = self.lower and all(
            self._model(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("a", "the", "zebra", "qxz", "thnderly")
        )
        self.marks = "".join(c for c in string.punctuation if self._apart(c) and self._apart(c + c)).encode()

    def _apart(self, marks: str) -> bool:
        """Whether marks behind letters have ids of their own."""
        parts = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("ab", marks, f"ab{marks}")]
        return parts[0] + parts[1] == parts[2]

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]

    def _pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _letters(self, word: str) -> str | None:
        """The word as the model sees it, if it is of letters that the normalizer leaves as they are."""
        try:
            return "".join(map(self.letters.__getitem__, word))
        except KeyError:
            for c in set(word) - self.letters.keys():
                seen = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)
                if not c.isalpha() or self.tokenizer.normalizer.normalize_str(c) != c or len(seen) != 1:
                    return None
                self.letters[c] = seen[0][0]
            return "".join(map(self.letters.__getitem__, word))

    def _ends_plainly(self, core: bytes) -> bool:
        """Whether the last character is an ASCII letter, or a letter that the normalizer leaves as it is."""
        if core[-1] < 128:
            return core[-1:].isalpha()
        last = core.decode()[-1]
        return last.isalpha() and self.tokenizer.normalizer.normalize_str(last) == last

    def _learn(self, word: bytes) -> bytes:
        """ids of a word that is not in the cache."""
        if self.plain:
            if word.islower() and word.isalpha():
                return self._pack([t.id for t in self.model.tokenize(word.decode())])
            core = word.rstrip(self.marks)
            tail = word[len(core) :]
            if tail and (not core or any(mark in word.lower() for mark in self.special)):
                core, tail = word, b""
            # What the normalizer makes of the last letter must be a letter, or the mark would join it.
            ids = self.cache.get(core) if tail and self._ends_plainly(core) else None
            if ids is None:
                if core.isalpha() and core.islower():
                    ids = self._pack(self._model(core.decode()))
                elif not core.isascii():
                    text = core.decode()
                    plain = text.isalpha() and unicodedata.is_normalized("NFC", text) and self._letters(text)
                    ids = self._pack(self._model(plain)) if plain else None
            if ids is not None:
                return ids + self._mark(tail) if tail else ids
        return self._pack(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def _mark(self, tail: bytes) -> bytes:
        return self.cache[tail]

    def _lowered(self, text: bytes) -> bytes:
        if not self.lower:
            return text
        low = text.lower()
        if any(mark in low for mark in self.special):
            return text
        if text.isascii() or all(unicodedata.is_normalized("NFC", t.decode()) for t in (text, low)):
            return low
        return text

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Serialized ids of each text, without special tokens."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [self._pack(e.ids) for e in found]
        out = []
        for text in texts:
            if len(self.cache) > CACHED_WORDS:
                # The words of the last while stay at hand; older ones go.
                self.older, self.cache = self.cache, _Cache(self)
            out.append(b"".join(map(self.cache.__getitem__, self._lowered(text).split())))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _texts(column: pa.Array):
    for at, data, bounds in slices(column, 1 << 20):
        raw = data.tobytes()
        yield at, [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample: int = SAMPLE) -> bytes:
    """A zstandard dictionary; plain content of the samples where they are too few to train on."""
    rows = docs.select("text").where("length(text) > 0").orderBy(F.xxhash64("text"), "text").limit(sample)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for _, texts in _texts(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([t + own._pack([end_id]) for t in own.encode(texts)], pa.binary())], ["x"])

    samples = sorted(bytes(r["x"]) for r in rows.mapInArrow(run, "x binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shards: int | None = None) -> None:
    """Encode and store the documents under ``path``, in ``shards`` ranges of doc_id."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = train_dictionary(docs, vocabulary, end_id)
    name = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(name, bytearray(words), vocabulary.rsplit("/", 1)[-1], end_id)], "hash string, dictionary binary, vocabulary string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(words)

    def run(batches):
        own = encoder(vocabulary)
        kind, end = own.type, own._pack([end_id])
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held.value), write_content_size=True)
        shard, part, before = TaskContext.get().partitionId(), 0, 0
        ids, frames, counts, size = [], [], [], 0

        def segment():
            known = np.array([i is not None for i in ids], dtype=np.uint8)
            numbers = np.array([i or 0 for i in ids], dtype="<i8")
            offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
            tokens = int(sum(counts))
            row = [shard, part, before, ids[0], ids[-1], len(ids), tokens, kind.itemsize, name, numbers.tobytes(), known.tobytes()]
            row += [offsets.tobytes(), np.array(counts, dtype="<u4").tobytes(), b"".join(frames)]
            types = [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.string()] + [pa.binary()] * 5
            names = [p.strip().split(" ")[0] for p in SEGMENT_SCHEMA.split(",")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for at, texts in _texts(batch.column("text")):
                for i, encoded in enumerate(own.encode(texts)):
                    encoded += end
                    ids.append(numbers[at + i])
                    frames.append(packer.compress(encoded))
                    counts.append(len(encoded) // kind.itemsize)
                    size += len(encoded)
                    if size >= SEGMENT_BYTES:
                        yield segment()
                        part, before = part + 1, before + int(sum(counts))
                        ids, frames, counts, size = [], [], [], 0
        if ids:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "none").parquet(f"{path}/segments")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    words = bytes(row["dictionary"])
    if hashlib.sha256(words).hexdigest() != row["hash"]:
        raise ValueError("the dictionary is damaged")
    return row["hash"], words


def _unpacker(words: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless left out, ids (array) of every document.

    ``start`` is the number of tokens of all documents before it. The crc is of the ids as little-endian
    unsigned 32-bit integers.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    name, words = _dictionary(spark, path)
    per_shard = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per shard.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_shard.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    held = spark.sparkContext.broadcast(words)

    def run(batches):
        unpacker = _unpacker(held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                if get("dictionary") != name:
                    raise ValueError("a segment was written with another dictionary")
                kind = np.dtype(f"<u{get('width')}")
                known = np.frombuffer(get("id_known"), dtype=np.uint8).astype(bool)
                ids = pa.array(np.frombuffer(get("ids"), dtype="<i8"), mask=~known)
                offsets, counts = np.frombuffer(get("offsets"), dtype="<u8"), np.frombuffer(get("counts"), dtype="<u4").astype(np.int64)
                payload = get("payload")
                own = [np.frombuffer(unpacker.decompress(payload[a:b]), dtype=kind).astype("<u4") for a, b in zip(offsets[:-1], offsets[1:])]
                if [len(x) for x in own] != counts.tolist():
                    raise ValueError("a frame does not have the tokens its index states")
                starts = get("base") + get("before") + np.cumsum(counts) - counts
                arrays = [ids, pa.array(starts), pa.array(counts), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(np.concatenate(own))).cast(pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return segments.join(bases, "shard").mapInArrow(run, schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the document (of each one, where the doc_id repeats). Only its segment and frame are read."""
    name, words = _dictionary(spark, path)
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    unpacker, found = _unpacker(words), []
    near = segments.where((F.coalesce("first_id", F.lit(doc_id)) <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard", "part")
    for row in near.toLocalIterator():
        if row["dictionary"] != name:
            raise ValueError("a segment was written with another dictionary")
        ids, known = np.frombuffer(bytes(row["ids"]), dtype="<i8"), np.frombuffer(bytes(row["id_known"]), dtype=np.uint8)
        offsets, payload = np.frombuffer(bytes(row["offsets"]), dtype="<u8"), bytes(row["payload"])
        for i in np.flatnonzero((ids == doc_id) & (known == 1)):
            frame = unpacker.decompress(payload[offsets[i] : offsets[i + 1]])
            found.append(np.frombuffer(frame, dtype=f"<u{row['width']}").tolist())
    return found
