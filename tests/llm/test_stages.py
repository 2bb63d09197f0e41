"""Faults of single stages: words after others in the cache, odd column names, tables without labels, many short texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from connlens.llm import language, queries, store, tokens


def test_ids_do_not_depend_on_what_was_seen_before():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary())
    own = tokens.Encoder(queries.vocabulary())
    rng = random.Random(7)
    letters = [chr(c) for c in [*range(0x41, 0x7B), *range(0xC0, 0x250), *range(0x370, 0x400), 0x1E9E, 0xFB01, 0x4E2D, 0xAC00, 0x130, 0x345, 0x5D0, 0xE01]]
    words = ["HAYDİ", "İ", "Ǆ", "ﬁ", "é", "é", "ẞ"] + ["".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(1500)]

    def packed(text):
        return np.array(plain.encode(text, add_special_tokens=False).ids, dtype=own.type).tobytes()

    for tail in ("", ",", ".", "", ".,"):
        rng.shuffle(words)
        texts = [w + tail for w in words] + [" ".join(w + tail for w in words[:200])]
        assert own.encode([t.encode() for t in texts]) == [packed(t) for t in texts]


def test_marks_behind_words_are_encoded_once():
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, plain):
            self.plain, self.asked = plain, []

        def __getattr__(self, name):
            return getattr(self.plain, name)

        def encode(self, word, **options):
            self.asked.append(word)
            return self.plain.encode(word, **options)

        def encode_batch_fast(self, words, **options):
            self.asked += words
            return self.plain.encode_batch_fast(words, **options)

    own = tokens.Encoder(queries.vocabulary())
    own.tokenizer = counted = Counted(Tokenizer.from_file(queries.vocabulary()))
    tails = ["$$$", ",%%%", "!!", ".", "'", "\"'", "_", "[/", "@@"]
    odd = ["<s", "<s>", "</s", "</s>", "a</s>", "[INST]", "x's!!", "x'", "'s!", "12%%%", "1.2.3!", "$$$", "é!!!", "Ée$$", "e\u0301??", "mas\u0338>"]
    texts = [f"qx{chr(97 + i % 26)}{chr(97 + i // 26)}{tail}" for i in range(300) for tail in tails] + odd
    found = own.encode([t.encode() for t in texts])
    assert len(counted.asked) < 100
    assert found == [own._pack(counted.plain.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("names", [["score", "_text", "lang_pred", "ambiguous", "_letter", "k0", "doc_id_"]])
def test_any_column_names(spark, names):
    rows = [(i, f"the text number {i} of this and that", "en", "s") for i in range(30)] + [(99, "12 34", None, None), (98, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    wide = docs.withColumns({n: F.lit(n) for n in names})
    kept = language.known_only(wide)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_without_labels_letters_decide(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None), (3, None, None)], "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in language.known_only(docs).collect()] == [1]
    assert language.known_only(docs.limit(0)).count() == 0


def test_texts_of_two_languages_at_once_go():
    """The flag, on features of known texts: one language each, and half and half."""
    one, other = "the cat and the dog ran over there ", "der Hund und die Katze liefen dorthin "
    texts = [one * k for k in range(3, 23)] + [other * k for k in range(3, 23)]
    x = np.concatenate([f for _, f in language.features(pa.array(texts))])
    model = language.fit(x, ["en"] * 20 + ["de"] * 20)
    mixed = np.concatenate([f for _, f in language.features(pa.array([one * 9, other * 9, " ".join([one, other] * 9)]))])
    p = np.sort(model.probabilities(mixed), axis=1)
    lead = p[:, -1] - p[:, -2]
    assert lead[0] > 0.5 and lead[1] > 0.5 and lead[2] < lead[:2].min()


def test_short_texts_take_bounded_room():
    sizes = [len(x) for _, x in language.features(pa.array(["ab"] * 10_000))]
    assert sum(sizes) == 10_000 and max(sizes) <= language.ROWS


@pytest.mark.parametrize("own, most", [(None, store.BATCH_BYTES), ("300k", 300 << 10)])
def test_stages_send_small_batches_to_python(spark, own, most):
    """Long texts of one partition, by their number all one batch; a bound of the session's own stays."""

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', repeat('and more of it ', 200)) AS text", "'en' AS lang", "'s' AS source").coalesce(1)
    if own:
        spark.conf.set(store.BATCH, own)
    try:
        for _, stage in corpus_pipeline.STAGES[:2]:
            stage(spark, docs.where("doc_id < 30"), "")
        seen = docs.select("doc_id", "text").mapInArrow(size, "n bigint, size bigint").collect()
    finally:
        spark.conf.unset(store.BATCH)
    assert sum(r.n for r in seen) == 2000
    assert max(r["size"] for r in seen) < 1.2 * most


def test_sample_is_held_once_on_the_driver(spark):
    docs = spark.range(1500).selectExpr("id AS doc_id", "concat('some text ', id, repeat(' of words', id % 50)) AS text", "array('en', 'de', 'fr')[id % 3] AS lang")
    tracemalloc.start()
    model = language.train(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ["de", "en", "fr"] and peak < 1.8 * 1500 * language.BUCKETS * 4


def test_sample_order_does_not_depend_on_its_parts():
    rng = np.random.default_rng(2)
    x = rng.random((700, language.BUCKETS), dtype=np.float32).astype(np.float16)
    names = [["en", "de"][i] for i in rng.integers(0, 2, 700)]
    whole = pa.RecordBatch.from_arrays([pa.array(names), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])
    shuffled = rng.permutation(700)
    parts = [whole.take(pa.array(shuffled[:10])).slice(0, 0), whole.take(pa.array(shuffled)).slice(0, 333), whole.take(pa.array(shuffled)).slice(333)]
    first, second = language._in_order([whole]), language._in_order(parts)
    assert np.array_equal(first[0], second[0]) and first[1] == second[1] and parts == []
    order = np.lexsort((x[:, :64].astype(np.float32).sum(axis=1), names))
    assert np.array_equal(first[0], x[order].astype(np.float32)) and first[1] == [names[i] for i in order]
