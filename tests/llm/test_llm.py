"""Each operator against brute force, a round trip or held-out labels, and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from connlens.llm import chat, decontaminate, exact, jaccard, language, mixing, pii, queries, scoring, tokens, toxicity, words
from connlens.llm.store import shared_folder
from oracle import duck, duck_result, spark_result

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, size int, digest string, n int"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
NEAR = " ".join(f"n{i}" for i in range(60))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, "The quick  brown fox jumps over the lazy dog\tagain and again", "en", "a"),
    (2, "The quick  brown fox jumps over the lazy dog\tagain and again", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n", None, "b"),
    (6, LONG, "en", "b"),
    (7, LONG, "en", "c"),
    (8, NEAR, "de", "c"),
    (9, NEAR + " more", "de", None),
    (10, "123 456 !!", None, "c"),
    (11, "Éa été là; Straße 'H̱ <|endoftext|> <|ENDOFTEXT|> don't... can't,", "fr", "d"),
    (None, "a row without a number", "en", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and further columns."""
    return spark.createDataFrame([(*r, 7, "x", 1) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    columns, rows = spark_result(queries.all_queries()[name](spark, SF))
    assert rows
    assert (columns, rows) == duck_result(duck(SF), queries.ORACLES[name])


def test_words_and_shingles_do_not_depend_on_slices(monkeypatch):
    texts = [r[1] for r in ROWS]

    def found():
        out = []
        for _, data, bounds in words.slices(pa.array(texts, pa.string())):
            w = words.words_of(data, bounds, words.NOT_BLANK)
            s, cuts = words.shingles(w)
            out += [(tuple(w.hash[a:b]), tuple(s[c:d])) for a, b, c, d in zip(w.first[:-1], w.first[1:], cuts[:-1], cuts[1:])]
        return out

    whole = found()
    assert [len(w) for w, _ in whole] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    monkeypatch.setattr(words, "SLICE_BYTES", 10)
    assert found() == whole


def test_token_files_give_back_every_document(spark, odd):
    from tokenizers import Tokenizer

    path = shared_folder(spark)
    tokens.write_tokens(odd, path, queries.vocabulary(), shards=3)
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    plain = Tokenizer.from_file(queries.vocabulary())
    rows = sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc_id, text) in zip(got, rows, strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert len(tokens.read_document(spark, path, 2)) == 2
    assert tokens.read_document(spark, path, 99) == []


def test_tokens_of_an_empty_table(spark, none):
    path = shared_folder(spark)
    tokens.write_tokens(none, path, queries.vocabulary(), shards=2)
    assert tokens.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.length(c).cast("bigint")], ids=["hash", "clashing"])
def test_exact_duplicates(odd, hashed):
    rows = exact.duplicates(odd, hashed).collect()
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[strip(text)].append((-len(text or ""), doc_id is None, doc_id))
    expected = collections.Counter()
    for doc_id, text, *_ in ROWS:
        own = groups[strip(text)]
        keep = min(own)[2]
        expected[(doc_id, keep, len(own), doc_id == keep, hashlib.sha256(strip(text).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == expected


def test_chunks_join_to_the_text(spark):
    texts = [LONG, "x" * 10_000, "é\U0001f600\n" * 3000, "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", exact.chunks(F.col("text")).alias("c")).collect():
        assert "".join(row.c) == row.text and max(map(len, row.c)) <= exact.MOST


def components_by_hand(rows):
    sets, parent = {}, {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        parent[doc_id] = doc_id
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and parent[a] != parent[b]:
                    parent[a] = parent[b] = min(parent[a], parent[b])
                    changed = True
    return {i: (len(sets[i]), parent[i]) for i in ids}


def test_jaccard_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    base = [f"b{i}" for i in range(40)]
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    # A chain of near copies, of which the ends are not alike, and texts that share a passage only.
    rows += [(100 + k, " ".join(base[k:] + [f"c{i}" for i in range(k)])) for k in range(12)]
    rows += [(200 + k, " ".join(base[:15] + [f"d{k}x{i}" for i in range(20)])) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == components_by_hand(rows)
    assert {r.doc_id for r in jaccard.one_of_each(df).collect()} == {c for _, c in got.values()}


def test_parity_bitmaps_never_differ_more_than_the_sets():
    random = np.random.default_rng(5)
    for n in (1, 2, 31, 32, 33, 500, 3000):
        own = words.mix(np.arange(n, dtype=np.uint64))
        assert jaccard._differing(jaccard._parity(own), jaccard._parity(own)) == 0
        for share in (0.3, 0.8, 0.95, 1.0):
            kept = own[random.random(n) < share]
            other = np.concatenate([kept, words.mix(np.arange(10**6, 10**6 + max(1, n - len(kept)) * 2, dtype=np.uint64))])
            apart = len(np.setxor1d(own, other))
            differ = jaccard._differing(jaccard._parity(own), jaccard._parity(other))
            assert differ <= apart and (apart - differ) % 2 == 0


def test_jaccard_odd_rows(odd, none):
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    assert {r.n_shingles for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (8, 9)} == {8}
    assert jaccard.near_duplicates(none).count() == 0


def test_decontamination_by_hand(spark, odd, none):
    bench = spark.createDataFrame(
        [(1, " ".join(f"w{i}" for i in range(30, 45))), (2, "LAZY dog"), (3, None), (4, "..."), (2, "lazy dog"), (5, "not there at all")],
        "item_id bigint, text string",
    )
    index = decontaminate.build_index(odd, words_each=50)
    found = decontaminate.report(index, decontaminate.search(index, bench))
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect())
    expected = collections.Counter()
    windows = {}
    for item, text in bench.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for doc_id, text, *_ in ROWS:
        w, hit, items = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    items |= windows[tuple(w[i : i + size])]
        expected[(doc_id, len(w), len(hit), len(items), bool(hit))] += 1
    assert got == expected
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    empty = decontaminate.build_index(none)
    assert decontaminate.report(empty, decontaminate.search(empty, bench)).count() == 0
    assert decontaminate.search(index, bench.where("false")).count() == 0


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "one two three x four five six"), (2, "one two three four five six")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    index = decontaminate.build_index(docs)
    kinds = lambda slop: {(r.doc_no, r.kind) for r in decontaminate.search(index, bench, slop).collect()}
    first = {r.doc_id: r.doc_no for r in decontaminate.indexed_documents(index).where("segment is not null").collect()}
    assert {k for _, k in kinds(0)} == {"phrase"} and len(first) == 2
    assert {k for _, k in kinds(2)} == {"phrase", "near"}


def test_near_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    item = [f"p{i}" for i in range(14)]
    texts = [item[:6] + ["x"] + item[6:], item[:3] + item[4:], item[1:2] + item[:1] + item[2:], item[:6] + ["x"] * 9 + item[6:], item, []]
    texts += [item[:9][::-1], ["y"] + item[2:12], item[:9] + item[10:11] + item[9:10]]
    texts += [[f"p{i}" for i in rng.integers(0, 5, 12)] for _ in range(40)]
    bench = [(1, " ".join(item)), (2, "p0 p1 p2 p3"), (3, "p1 p0 p4"), (4, "x y")]
    docs = list(enumerate(" ".join(t) for t in texts))
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    often = collections.Counter(w for t in texts for w in t)
    slop, expected = decontaminate.SLOP, {}
    for doc_id, t in enumerate(texts):
        phrase, near = set(), set()
        for number, text in bench:
            words_of_item = text.split()
            for i in range(max(1, len(words_of_item) - 9)):
                window = words_of_item[i : i + 10]
                rare = min(range(len(window)), key=lambda j: (often[window[j]], j))
                for start in range(-slop, len(t)):
                    if start + len(window) > len(t) + slop or not 0 <= start + rare < len(t) or t[start + rare] != window[rare]:
                        continue
                    if start >= 0 and t[start : start + len(window)] == window:
                        phrase.add(number)
                    elif all(word in t[max(start + j - slop, 0) : max(start + j + slop + 1, 0)] for j, word in enumerate(window)):
                        near.add(number)
        expected[doc_id] = (len(phrase), len(near - phrase))
    rows = queries.all_queries()["op10_near_matches"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_items, r.n_near) for r in rows} == expected
    assert all(r.contaminated == (r.n_items > 0) for r in rows) and expected[0] == (1, 2) and expected[1][1] and expected[2][1]


def test_mixing_reaches_targets(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).withColumnRenamed("doc_id", "i").join(docs.select(F.col("doc_id").alias("i"), "source"), "i").collect()
    size, taken, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in rows:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(size))}
    total, open_, wanted = sum(size.values()), set(size), {}
    while True:
        rest = total - sum(wanted.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            wanted |= share
            break
        wanted |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    for s in size:
        assert math.isclose(target[s], wanted[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= largest[s]
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert again == {(r.i, r.taken) for r in rows}
    assert mixing.mix(odd).count() == len(ROWS) and mixing.mix(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_language_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.99 * len(rows)
    got = language.identify(odd).collect()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 10)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(ROWS)
    assert language.identify(none).count() == 0
    assert {r.doc_id for r in language.known_only(odd).collect()} == {1, 2, 6, 7, 8, 9, 11, None}


def test_codewords_differ():
    for k in range(2, 12):
        code = language.codewords(k)
        assert len({tuple(r) for r in code}) == k


def test_toxicity_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    bad = sorted(r.score for r in rows if r.toxic == 1)
    good = sorted(r.score for r in rows if r.toxic == 0)
    wins = np.searchsorted(good, bad).sum() / len(bad) / len(good)
    assert wins > 0.97
    assert sum(s >= 0.5 for s in bad) > 0.75 * len(bad) and sum(s >= 0.5 for s in good) < 0.01 * len(good)
    marks = spark.createDataFrame([(1, 1), (1, None), (8, 0), (6, 0), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.toxicity(odd, marks).count() == len(ROWS)
    assert toxicity.toxicity(odd, marks.where("false")).where("score <> 0").count() == 0
    assert toxicity.toxicity(none, marks).count() == 0


def test_cut_labels_keep_the_share_of_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")

    def means(rows):
        scored = toxicity.score(docs, toxicity.train(docs, labels, rows), ["doc_id"]).join(labels.where("toxic IS NOT NULL"), "doc_id")
        return scored.agg(F.avg("score"), F.avg("predicted")).first()

    for cut, whole in zip(means(300), means(toxicity.TRAIN_ROWS)):
        assert abs(cut - whole) < 0.03


def test_machine_learns_a_pair():
    """Neither word alone says anything, both together do."""
    rng = np.random.default_rng(3)
    rows, label = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([k for k, on in ((10, a), (20, b)) if on] + [100 + int(rng.integers(0, 30))]))
        label.append(float(a and b))
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = toxicity.fit(np.concatenate(rows), cuts, np.array(label))
    margins = model.margins(np.array([10, 20, 10, 20]), np.array([0, 2, 3, 4]))
    assert margins[0] > 0 > max(margins[1], margins[2])


def test_machine_learns_a_pair_without_marginal_effects():
    """Toxic with one of two words, not with both or none: neither word alone says anything."""
    rng = np.random.default_rng(3)
    rows, label = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        others = rng.choice(300, 30, replace=False)
        rows.append(np.array([k for k, on in ((10, a), (20, b)) if on] + (100 + others).tolist()))
        label.append(float(a != b))
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = toxicity.fit(np.concatenate(rows), cuts, np.array(label))
    margins = model.margins(np.array([10, 20, 10, 20]), np.array([0, 2, 3, 4]))
    assert min(margins[1], margins[2]) > 0.5 and margins[0] < -0.5


def test_chat_round_trip(spark):
    texts = ["a\\b", "[INST]", "\\[INST]\\", "<s></s>[/INST] [ROLE]", "<<SYS>>x<</SYS>>", " lead", "trail ", "\\", " </s>", "", None, "\n\n", "é\U0001f600"]
    roles = ["user", "assistant", "system", "tool", "[ROLE] x [/ROLE]", None]
    rows = [(c, i, r, t) for c, r in enumerate(roles) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(None, None, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string")
    path = chat.format_conversations(df.withColumn("seq", F.lit("other")))
    got = {(r.conv_id, r.seq): (r.role, r.text) for r in chat.read_turns(spark, path).collect()}
    assert got == {(c, i + 1): (r or "", t or "") for c, i, r, t in rows} | {(None, 1): ("assistant", "x")}
    example = chat.examples_text(spark, path).where("conv_id = 1 AND seq = 2").first()
    assert example.context.endswith(" ") and example.target == "[\\INST]"
    for r in chat.digests(spark, path).collect():
        own = ["x"] if r.conv_id is None else [t or "" for t in texts] if r.conv_id == 1 else []
        assert r.loss_sha256 == hashlib.sha256("".join(own).encode()).hexdigest()
    assert chat.digests(spark, chat.format_conversations(df.where("false"))).count() == 0


def test_scores_beat_word_counts(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    counts = scoring.count_words(docs).toPandas()["n"].to_numpy()
    rows = scoring.pseudo_likelihood(docs).collect()
    mean = sum(r.log_likelihood for r in rows) / sum(r.n_words for r in rows)
    used = counts / counts.sum()
    assert mean > (used * np.log(used)).sum()
    got = {r.doc_id: r for r in scoring.pseudo_likelihood(odd).collect()}
    assert got[3].mean_log_likelihood is None and got[4].log_likelihood == 0 and math.isclose(got[6].log_likelihood, got[7].log_likelihood, rel_tol=1e-9)
    assert scoring.pseudo_likelihood(none).count() == 0


def test_network_gradient():
    rng = np.random.default_rng(1)
    net, around, target = scoring.Network(), rng.integers(0, scoring.CLASSES + 1, (4, 50)), rng.integers(0, scoring.CLASSES, 50)
    loss = lambda p: -scoring.Network(p).forward(around)[1][np.arange(50), target].mean()
    start = net.all.astype(np.float64)
    moved = scoring.Network(start.copy())
    moved.step(around, target, 1.0)
    slope = start - moved.all
    for i in np.argsort(-np.abs(slope))[::200][:8]:
        step = np.zeros_like(start)
        step[i] = 1e-5
        assert math.isclose((loss(start + step) - loss(start - step)) / 2e-5, slope[i], rel_tol=1e-3, abs_tol=1e-6)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def fine(kind, value):
        digits = re.sub("[^0-9]", "", value)
        luhn = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0
        return {
            "email": True,
            "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn,
            "phone": 9 <= len(digits) <= 15,
        }[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if fine(k, m[0]))


def test_personal_data(spark, odd, none):
    hard = [
        "a@b.c%x@d.e y", "a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1.1 0255.1.1.01 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111  111111111111",
        "+1 (785) 555-9997 +12 +1((((( ++1-234-567-890", "é\U0001f600 a@b.cd \U0001f600 1.1.1.1", "@", "a" * 3000 + "1" * 3000 + "." * 50, None, "", "378282246310005",
    ]
    people = [(1000 + i, f"some words here and then write to user{i}@mail.org now and later") for i in range(8)]
    people += [(2000, "once more then write to USER-778899 now, please"), (2001, "no 123456 here")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50 + i, t) for i, t in enumerate(hard)] + people, "doc_id bigint, text string"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(ROWS) + len(hard) + len(people)
    for r in rows:
        expected = base_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert ",".join(p for p in r.spans.split(",") if not p.startswith("context")) == expected
    found = {r.doc_id: [text[r.doc_id][int(p.split(":")[1]) : int(p.split(":")[2])] for p in r.spans.split(",") if p.startswith("context")] for r in rows}
    assert found[2000] == ["USER-778899"] and not found[2001]
    assert pii.personal_data(none).count() == 0
    plan = pii.scanned(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
    known = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, sf).collect()}
    found = language.predict(docs.select("doc_id", "text"), language.train(docs), ["doc_id", "text"]).collect()
    assert known == {r.doc_id for r in found if r.lang_pred != "und" and not (r.ambiguous and len(r.text) >= 200)}
    rows = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert rows and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
