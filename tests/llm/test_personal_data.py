"""Personal data found by contexts, against a plain version of the same rounds."""

import re
from collections import defaultdict

import pytest

from connlens.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, base):
    """rows: text by doc_id; base: (start, end) of the fixed spans by doc_id. Spans found by contexts by doc_id."""
    places = []
    for doc, text in rows.items():
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        name = lambda i: text[words[i][0] : words[i][1]].lower() if 0 <= i < len(words) else None  # noqa: B023, E731
        for start, end in base[doc]:
            at = max(i for i, w in enumerate(words) if w[0] <= start)
            after = next((i for i, w in enumerate(words) if w[0] >= end), len(words))
            places.append((doc, start, end, text[start:end].lower(), True, name(at - 2), name(at - 1), name(after)))
        for i, (start, end) in enumerate(words):
            if any(s < end and e > start for s, e in base[doc]):
                continue
            letters = [k for k in range(start, end) if text[k] not in pii.MARKS]
            if letters:
                a, b = letters[0], letters[-1] + 1
                places.append((doc, a, b, text[a:b].lower(), False, name(i - 2), name(i - 1), name(i + 1)))

    def patterns(place):
        two, one, after = place[5:]
        return ([("2", two, one)] if two is not None else []) + ([("1", one, after)] if one is not None and after is not None else [])

    members, contexts, seeds = defaultdict(set), defaultdict(set), defaultdict(set)
    for place in places:
        for pattern in patterns(place):
            members[pattern].add(place[3])
            if place[4]:
                seeds[place[3]].add(pattern)
        contexts[place[3]].add(tuple(patterns(place)))
    known, beside = {p[3] for p in places if p[4]}, defaultdict(set)
    for instance, own in seeds.items():
        for pattern in own:
            beside[pattern].add(instance)
    while True:
        worth = {p: len(own) / len(members[p]) for p, own in beside.items() if len(own) >= pii.SUPPORT}
        worth = {p: w for p, w in worth.items() if w >= pii.TRUST}
        new = set()
        for instance, own in contexts.items():
            if instance not in known and any(p in worth for c in own for p in c):
                if sum(max((worth.get(p, 0) for p in c), default=0) for c in own) / len(own) >= pii.BELIEF:
                    new.add(instance)
        if not new:
            break
        known |= new
        for instance in new:
            for context in contexts[instance]:
                for pattern in context:
                    beside[pattern].add(instance)
    out = defaultdict(set)
    for place in places:
        if not place[4] and place[3] in known and any(p in worth for p in patterns(place)):
            out[place[0]].add((place[1], place[2]))
    return {doc: sorted(spans) for doc, spans in out.items()}


def found_spans(docs):
    base, context = {}, {}
    for r in docs.collect():
        parts = [p.split(":") for p in r.spans.split(",") if p]
        base[r.doc_id] = sorted((int(a), int(b)) for kind, a, b in parts if kind != "context")
        own = sorted((int(a), int(b)) for kind, a, b in parts if kind == "context")
        if own:
            context[r.doc_id] = own
    return base, context


def texts():
    names = ["anna", "boris", "clara", "dora", "emil", "frida", "gustav", "hanna", "igor", "jana"]
    rows = [f"please write to {n}@mail.example now and wait" for n in names]
    rows.append("please write to Étoile-mauve now and wait")  # neither digit nor sign of a known kind
    rows.append("please write to him now and wait")
    rows += [f"we saw him {n} and then him again" for n in names]  # so him is an ordinary word
    # A second round: what the first finds brings the pattern "badge number".
    ids = ["redfox", "bluejay", "greyowl", "tanhare", "oldstag"]
    rows += [f"please write to {n}, now; badge number {n} is valid" for n in names[:2]]
    rows += [f"kindly write to {n} now. then badge number {n} was seen" for n in ids]
    rows += ["then badge number silverpike was seen", "a call from +1 (785) 555-9997 at 4111 1111 1111 1111 came", "", None]
    rows.append(" ".join(f"w{i}" for i in range(700)) + " please write to whitecrane now " + " ".join(f"v{i}" for i in range(300)))
    rows.append(" ".join("please write to x@y.zz now" for _ in range(60)) + " please write to brownbear now")
    return rows


def test_contexts_match_plain_rounds(spark):
    # More mailed people, so that the words found later are a small share of the pattern's.
    rows = texts() + [f"please write to more{chr(97 + i)}@mail.example now and wait" for i in range(26)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").selectExpr("doc_id", "text", "1 AS start", "'x' AS mark")
    base, context = found_spans(pii.personal_data(docs))
    text = {i: t or "" for i, t in enumerate(rows)}
    assert context == brute(text, base)
    words = {text[d][a:b] for d, own in context.items() for a, b in own}
    assert {"Étoile-mauve", "redfox", "whitecrane", "brownbear", "silverpike"} <= words and "him" not in words


def test_parts_change_nothing(spark, monkeypatch):
    """Patterns that a first part of the rows rules out, and one that is followed again once more words are known."""
    monkeypatch.setattr(pii, "PART", 3)
    monkeypatch.setattr(pii, "FOLD", 5)
    rows = texts() + [f"please write to more{i}@mail.example now and wait" for i in range(90)]
    names = ["palecrow", "dimwolf", "icelynx", "wetmole", "shymink", "oldcarp", "redtoad", "bigvole"]
    rows += [f"all of them write to {n} now. see id code {n} here" for n in names]
    rows += [f"see id code u{i}@mail.example here" for i in range(5)] + ["see id code silvercat here"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    assert len(pii._parts(docs.selectExpr("doc_id", "text", "xxhash64(text) AS mark"))) > 2
    base, context = found_spans(pii.personal_data(docs))
    text = {i: t or "" for i, t in enumerate(rows)}
    assert context == brute(text, base)
    assert {text[d][a:b] for d, own in context.items() for a, b in own} >= {"redfox", "icelynx", "silverpike", "silvercat"}


def test_words_by_an_ordinary_pattern_are_not_all_gathered(spark, monkeypatch):
    monkeypatch.setattr(pii, "PART", 100, raising=False)
    rows = [f"it was seen in the w{chr(97 + i % 26)}x{i} place" for i in range(4000)]
    rows += [f"it was seen in the {chr(97 + i)}@mail.example place" for i in range(6)]
    kept, stored = [], pii.stored

    def counted(df):
        out = stored(df)
        if set(out.columns) == {"pattern", "instance"}:
            kept.append(out.count())
        return out

    monkeypatch.setattr(pii, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    base, context = found_spans(pii.personal_data(docs))
    assert not context and sum(map(len, base.values())) == 6
    assert sum(kept) < 2000


def test_no_context_to_trust(spark):
    rows = [(1, "one mail to a@b.cd only"), (1, "one mail to a@b.cd only"), (2, None), (None, "c@d.ef")]
    base, context = found_spans(pii.personal_data(spark.createDataFrame(rows, "doc_id int, text string")))
    assert base == {1: [(12, 18)], 2: [], None: [(0, 6)]} and not context


@pytest.mark.parametrize("n", [127, 128, 129, 256, 257])
def test_blocks_of_words(spark, n):
    text = " ".join(["w"] * n) + " a@b.cd z"
    source = pii.seeded(pii.scanned(spark.createDataFrame([(1, text), (2, "no span")], "doc_id int, text string")))
    assert [tuple(r) for r in pii.seed_rows(source).collect()] == [("a@b.cd", "2 w w", "1 w _ z")]
    places = [r.place for r in pii.word_rows(source).where("doc_id = 1").orderBy("place").collect()]
    assert places == [*range(n), n + 1] and pii.word_rows(source).where("doc_id = 2").count() == 2
    plan = pii.word_rows(source)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
