"""Hashes of words."""

import tracemalloc

import numpy as np
import pyarrow as pa

from connlens.llm import decontaminate, words


def test_regular_long_words_differ():
    """A Thue-Morse word and its complement are equal in any power sum modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    for size in (64, 65, 256, 1024, 2048, 4096):
        pair = ["".join("ab"[b ^ flip] for b in bits[:size]) for flip in (0, 1)]
        for text in (" ".join(pair), f"x {pair[0]} {pair[1]} y"):
            for _, data, bounds in words.slices(pa.array([text])):
                hashes = words.words_of(data, bounds, words.NOT_BLANK).hash
                assert len(np.unique(hashes)) == len(hashes)


def test_long_words_are_equal_wherever_they_stand():
    long = "Q" * 65 + "é" * 40
    texts = [long, f"a {long.lower().replace('É', 'é')} b", long + "x", None, ""]
    (_, data, bounds), = words.slices(pa.array(texts))
    found = words.words_of(data, bounds, words.NOT_BLANK)
    assert found.count().tolist() == [1, 3, 1, 0, 0]
    assert found.hash[0] == found.hash[2] and found.hash[0] != found.hash[4]


def test_powers_are_held_for_the_longest_slice_only(monkeypatch):
    one = np.ones(1, dtype=np.uint64)
    monkeypatch.setattr(words._Powers, "up", one)
    monkeypatch.setattr(words._Powers, "down", one)
    for n in (500_000, 500_001, 600_000, 700_000):
        up, down = words._Powers.of(n)
        assert n <= len(up) == len(down) < n + (1 << 17)
        assert np.all(up[:n] * down[:n] == 1)


def test_index_hashes_a_few_texts_at_a_time():
    texts = pa.array([f"word{i} and more words {i}" * 40 for i in range(4000)])
    tracemalloc.start()
    found = sum(len(w.hash) for _, w in decontaminate._words(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 400_000 and peak < 25e6
