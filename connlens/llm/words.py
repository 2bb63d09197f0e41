"""Words of whole Arrow batches as numpy arrays, without a Python step per word.

A word is a run of bytes of a class (UTF-8 bytes over 127 count as one more
class member or not, as a whole). Texts are never cut: a batch is worked on in
slices of about ``SLICE_BYTES``, and a longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
POWER_STEP = 1 << 16
# Of more bytes than these a word's hash is a cryptographic one: regular long words would collide in the sum.
LONG_WORD = 64

# The white space of the contracts: blank and 0x09 to 0x0D.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_BLANK = ~_BLANK

# Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64: every input bit moves every output bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, as long as any slice needed. They stay in each Python worker."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            # Not doubled: slices differ by little, and twice the longest would be held for good.
            size = -(-n // POWER_STEP) * POWER_STEP
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


@dataclass
class Words:
    """The words of some texts, in order."""

    texts: int
    doc: np.ndarray  # index of the text of each word
    hash: np.ndarray  # 64-bit hash of the word
    first: np.ndarray  # index of the first word of each text, and the number of words at the end

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, bounds: np.ndarray, member: np.ndarray, lower: bool = True) -> Words:
    """data: the UTF-8 bytes of all texts; bounds: where each begins, and the end."""
    n, texts = len(data), len(bounds) - 1
    if n == 0:
        empty = np.zeros(0, dtype=np.uint64)
        return Words(texts, empty.astype(np.int64), empty, np.zeros(texts + 1, dtype=np.int64))
    if lower:
        data = LOWER[data]
    inside = member[data]
    begins, ends = inside.copy(), inside.copy()
    cuts = bounds[(bounds > 0) & (bounds < n)]
    begins[1:] &= ~inside[:-1]
    begins[cuts] |= inside[cuts]
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _Powers.of(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    for i in np.flatnonzero(end - start > LONG_WORD):
        hashed[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    first = np.searchsorted(start, bounds).astype(np.int64)
    doc = np.repeat(np.arange(texts), np.diff(first))
    return Words(texts, doc, hashed, first)


def slices(texts: pa.Array, most: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, bounds) of slices; null counts as empty."""
    most = most or SLICE_BYTES
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_FACTORS = np.array(
    [0xD6E8FEB86659FD93, 0xA3B195354A39B70D, 0x1B03738712FAD5C9, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3],
    dtype=np.uint64,
)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and the bounds of each text in them.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    h, counts = words.hash, words.count()
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * _FACTORS[0]) | np.uint64(1)
    total = len(h)
    long = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (counts < size)
    each = np.where(short, 1, long)
    bounds = np.zeros(words.texts + 1, dtype=np.int64)
    np.cumsum(each, out=bounds[1:])
    out = np.zeros(bounds[-1], dtype=np.uint64)
    if total >= size:
        rolled = np.zeros(total - size + 1, dtype=np.uint64)
        for j in range(size):
            rolled += h[j : total - size + 1 + j] * factors[j]
        at = np.arange(total - size + 1)
        whole = words.first[words.doc[: total - size + 1] + 1] - at >= size
        target = np.repeat(~short, each)
        out[target] = mix(rolled[whole])
    for d in np.flatnonzero(short):
        own = h[words.first[d] : words.first[d + 1]]
        mixed = len(own) * _FACTORS[1:2] + (own * factors[: len(own)]).sum(dtype=np.uint64, keepdims=True)
        out[bounds[d]] = mix(mixed ^ _FACTORS[2])[0]
    return out, bounds

