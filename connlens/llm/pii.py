"""Personal data: fixed kinds by pattern, and more identifiers by bootstrapped contexts.

E-mail addresses, IP addresses, card and phone numbers are found by their patterns. Every one is
a seed. What stands around it, the two words before it, or one on each side, is a lexical pattern.
Patterns and the words they stand by, of whatever characters, make a graph, scored in rounds:

- a pattern that stands by ``SUPPORT`` different known identifiers or more is worth the share of
  known ones (seeds and found words) among all the different words and seeds it stands by; it is trusted from ``TRUST`` on;
- a word beside a trusted pattern is worth the mean, over all its different contexts in the
  corpus, of the greater worth of their two patterns. So an ordinary word is held down by
  its other uses. From ``BELIEF`` on it is known.

Rounds go on until none adds an identifier; what is known stays known, so they end. Found words
become spans of kind ``context`` wherever they stand by a trusted pattern. Edges of the
graph are gathered only for patterns with support and words beside trusted ones. They are gathered from one part of the
rows after the other, each larger than those before: a pattern that stands by so many different words already
that it is worth less than ``TRUST`` is not followed further, until more of them are known. All parts together are the
whole table, and a pattern is judged by all of them, so the parts change what is gathered and never what is found.

DataFrame operations only. A null text is empty and has no spans; an empty table gives no rows. Positions
are code points, ends exclusive. Extra columns are ignored; repeated rows have equal results. There are
no ties: all limits are inclusive. Words are lower-cased and without ``MARKS`` at their ends; a fixed span of more than
``BEYOND`` words has no pattern on both sides. Matching takes time in proportion to the text: no pattern
is tried again inside a run of its characters. Only texts with a fixed span have their words placed before something is found;
the passes over all words explode them and join on patterns or words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"

# The leftmost matches of the plain patterns. A run of characters is entered at its start, or where a match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of digits with single separators; only one of 13 to 19 digits is a match.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must have for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

WORD = r"[^\x20\x09-\x0D]++"
TRUST = 0.8
BELIEF = 0.4  # about half of a word's contexts are trusted ones
SUPPORT = 5
PART = 2000  # rows that are first looked at for what speaks against a pattern
FOLD = 8
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026"  # around a word
BEYOND = 64  # words after a block in which the word after a span is looked for
MANY = 2**31 - 1  # as far as an array goes
BLOCK = 128  # matches of a text that are worked on together

SPANS = "array<struct<start:int,end:int,value:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def located(text: str, pattern: str) -> Column:
    """start, end and value of every match in order.

    The matches and the text between them are added up in blocks, then within each block from where
    it begins, so that a text with many matches takes time in proportion to them.
    """
    p = _quoted(pattern)
    pieces = f"""filter(zip_with(
        regexp_extract_all({text}, {p}, 0),
        split({text}, {p}, -1),
        (m, g) -> named_struct('m', m, 'g', g)), x -> x.m IS NOT NULL)"""
    blocks = f"transform(sequence(0, size(p) div {BLOCK}), k -> slice(p, k * {BLOCK} + 1, {BLOCK}))"
    width = "aggregate(b, 0, (n, x) -> n + length(x.g) + length(x.m))"
    begins = f"""aggregate(bs, named_struct('at', 0, 'out', CAST(array() AS array<int>)),
        (s, b) -> named_struct('at', s.at + {width}, 'out', concat(s.out, array(s.at))), s -> s.out)"""
    spans = f"""aggregate(b, named_struct('at', o, 'out', CAST(array() AS {SPANS})),
        (s, x) -> named_struct(
          'at', s.at + length(x.g) + length(x.m),
          'out', concat(s.out, array(named_struct('start', s.at + length(x.g), 'end', s.at + length(x.g) + length(x.m), 'value', x.m)))),
        s -> s.out)"""
    # transform(array(x), name -> ...)[0] gives a value a name.
    inner = f"transform(array({blocks}), bs -> flatten(zip_with(bs, {begins}, (b, o) -> {spans})))[0]"
    return F.expr(f"transform(array({pieces}), p -> {inner})[0]")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (2 - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (bare.substr(1, 3).cast("int") <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: F.length(_digits(v)).between(13, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _checked(kind: str):
    return lambda span: VALID[kind](span["value"])


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, mark (hash of the text), text and an array of spans for each kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("mark"))
    none = F.array().cast(SPANS)
    found = {}
    for kind in KINDS:
        spans = F.filter(located("text", PATTERNS[kind]), _checked(kind))
        able = F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        found[kind] = F.when(able & F.col("text").rlike(PATTERNS[kind]), spans).otherwise(none)
    return rows.select("doc_id", "mark", "text", *[column.alias(name) for name, column in found.items()])


def seeded(found: DataFrame) -> DataFrame:
    """doc_id, mark, text, seeds and covered of every row.

    ``seeds`` are the fixed spans with the words around them, ``covered`` the places of the words in
    fixed spans among those of the text.
    """
    rows = found.select("doc_id", "mark", "text", F.array_sort(F.concat(*KINDS)).alias("spans"))
    words = F.when(F.size("spans") > 0, located("text", WORD)).otherwise(F.array().cast(SPANS))
    # Blocks of words, with two words before and BEYOND after, and the spans that reach into each.
    blocks = f"""transform(sequence(0, (size(words) - 1) div {BLOCK}), k -> named_struct(
        'from', k * {BLOCK}, 'near', slice(words, greatest(k * {BLOCK} - 1, 1), {BLOCK + BEYOND} + if(k = 0, 0, 2)),
        'own', slice(words, k * {BLOCK} + 1, {BLOCK})))"""
    reach = "transform(blocks, b -> named_struct('b', b, 'spans', filter(spans, s -> s.start < element_at(b.own, -1).end AND s.end > b.own[0].start)))"
    seeds = """flatten(transform(reach, r -> transform(
        transform(filter(r.spans, s -> s.start >= r.b.own[0].start), s -> named_struct('s', s, 'i', size(filter(r.b.near, w -> w.start <= s.start)))),
        x -> named_struct('value', x.s.value, 'b2', get(r.b.near, x.i - 3).value, 'b1', get(r.b.near, x.i - 2).value,
          'a1', get(filter(r.b.near, w -> w.start >= x.s.end), 0).value))))"""
    covered = """flatten(transform(reach, r -> transform(
        filter(transform(r.b.own, (w, i) -> named_struct('w', w, 'i', i)), x -> exists(r.spans, s -> s.start < x.w.end AND s.end > x.w.start)),
        x -> x.i + r.b.from)))"""
    rows = rows.withColumn("words", words).withColumn("blocks", F.when(F.size("words") > 0, F.expr(blocks)))
    rows = rows.withColumn("reach", F.expr(reach))
    return rows.select("doc_id", "mark", "text", F.expr(seeds).alias("seeds"), F.expr(covered).alias("covered"))


def _patterns() -> list[Column]:
    """The pattern of the two words before, and that of a word on each side; null where the text ends."""
    two = F.when(F.col("b2").isNotNull(), F.concat(F.lit("2 "), "b2", F.lit(" "), "b1"))
    sides = F.when(F.col("b1").isNotNull() & F.col("a1").isNotNull(), F.concat(F.lit("1 "), "b1", F.lit(" _ "), "a1"))
    return [two.alias("two"), sides.alias("sides")]


def seed_rows(source: DataFrame) -> DataFrame:
    """instance, two and sides of every fixed span."""
    each = source.select(F.explode("seeds").alias("s")).select(*[F.lower(f"s.{c}").alias(c) for c in ("value", "b2", "b1", "a1")])
    return each.select(F.col("value").alias("instance"), *_patterns())


def word_rows(source: DataFrame) -> DataFrame:
    """doc_id, mark, place, instance, two and sides of every word outside of fixed spans."""
    rows = source.select("doc_id", "mark", "covered", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w"))
    none = F.lit(None).cast("string")
    beside = F.arrays_zip(
        F.col("w").alias("w"), F.concat(F.array(none), "w").alias("b1"), F.concat(F.array(none, none), "w").alias("b2"), F.slice("w", 2, MANY).alias("a1")
    )
    each = rows.select("doc_id", "mark", "covered", F.posexplode(beside).alias("place", "x")).where("x.w IS NOT NULL")
    each = each.select("doc_id", "mark", "covered", "place", F.btrim("x.w", F.lit(MARKS)).alias("instance"), "x.b2", "x.b1", "x.a1")
    each = each.where("instance <> '' AND (covered IS NULL OR NOT array_contains(covered, place))")
    return each.select("doc_id", "mark", "place", "instance", *_patterns())


def _edges(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows once for each of their patterns."""
    each = rows.select(*columns, F.explode(F.array("two", "sides")).alias("pattern"))
    return each.where(F.col("pattern").isNotNull())


def _parts(source: DataFrame) -> list[DataFrame]:
    """All rows once, dealt by hash into parts: about ``PART`` rows, then always ``FOLD`` times as many as up to there."""
    total, bound, low, parts = source.count(), PART, 0.0, []
    place = F.xxhash64("doc_id", "mark").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    while bound < total:
        parts.append(source.where((place >= low) & (place < bound / total)))
        bound, low = bound * FOLD, bound / total
    return [*parts, source.where(place >= low) if parts else source]


def bootstrapped(found: DataFrame) -> DataFrame | None:
    """doc_id, mark, start and end of the identifiers that the contexts discover; None where nothing can be."""
    source = stored(seeded(found))
    beside = stored(_edges(seed_rows(source), "instance").distinct())  # known identifiers and their patterns
    known = stored(seed_rows(source).select("instance").distinct())
    words = word_rows(source)
    parts = [_edges(word_rows(part), "instance") for part in _parts(source)]
    asked = [None] * len(parts)  # the patterns whose edges of a part are gathered
    seeds = beside
    edges = sizes = contexts = new_known = None
    while True:
        support = stored(beside.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT))
        for k, part in enumerate(parts):
            fresh = support
            if k:
                if asked[k - 1] is None:
                    break
                # A pattern's size only grows with the parts: what the earlier ones rule out can't be trusted in this round.
                size = sizes.groupBy("pattern").agg(F.sum("size").alias("size"))
                fresh = support.join(asked[k - 1], "pattern", "left_semi").join(size, "pattern", "left")
                fresh = fresh.where(F.col("size").isNull() | (F.col("n") / F.col("size") >= TRUST))
            fresh = fresh.select("pattern")
            fresh = stored(fresh if asked[k] is None else fresh.join(asked[k], "pattern", "left_anti"))
            if fresh.isEmpty():
                continue
            # Joined before the same edges are put together, so that words without such a pattern are not moved.
            more = part.join(fresh, "pattern", "left_semi")
            if k:
                more = more.distinct().join(edges, ["pattern", "instance"], "left_anti")
            else:
                more = more.unionByName(seeds.join(fresh, "pattern", "left_semi")).distinct()
            more = stored(more.select("pattern", "instance"))
            edges = more if edges is None else edges.unionByName(more)
            counted = stored(more.groupBy("pattern").agg(F.count("*").alias("size")))
            sizes = counted if sizes is None else sizes.unionByName(counted)
            asked[k] = fresh if asked[k] is None else asked[k].unionByName(fresh)
        if asked[-1] is None:
            return None
        # The known members are counted in beside, so the edges themselves need no join with the known words.
        whole = sizes.join(asked[-1], "pattern", "left_semi").groupBy("pattern").agg(F.sum("size").alias("size"))
        judged = support.join(whole, "pattern")
        trusted = stored(judged.select("pattern", (F.col("n") / F.col("size")).alias("worth")).where(F.col("worth") >= TRUST))
        near = edges.join(trusted, "pattern", "left_semi").select("instance").distinct().join(known, "instance", "left_anti")
        near = stored(near if contexts is None else near.join(contexts.select("instance").distinct(), "instance", "left_anti"))
        if not near.isEmpty():
            more = stored(words.select("instance", "two", "sides").join(near, "instance", "left_semi").distinct())
            contexts = more if contexts is None else contexts.unionByName(more)
        if contexts is None:
            return None
        worth = lambda side: trusted.select(F.col("pattern").alias(side), F.col("worth").alias(f"_{side}"))  # noqa: B023, E731
        scored = contexts.join(worth("two"), "two", "left").join(worth("sides"), "sides", "left")
        best = F.coalesce(F.greatest("_two", "_sides"), F.lit(0.0))
        scores = scored.groupBy("instance").agg(F.avg(best).alias("score")).where(F.col("score") >= BELIEF).select("instance")
        found_now = stored(scores.join(known, "instance", "left_anti"))
        if found_now.isEmpty():
            break
        new_known = found_now if new_known is None else new_known.unionByName(found_now)
        known = known.unionByName(found_now)
        beside = beside.unionByName(_edges(contexts.join(found_now, "instance", "left_semi"), "instance").select(*beside.columns).distinct())
    if new_known is None:
        return None
    rows = _edges(words.join(new_known, "instance", "left_semi"), "doc_id", "mark", "place").join(trusted, "pattern", "left_semi")
    places = rows.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("place").alias("places"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("mark").eqNullSafe(F.col("_mark"))
    held = source.select("doc_id", "mark", "text").join(places, same).select("doc_id", "mark", "places", located("text", WORD).alias("words"))
    each = held.select("doc_id", "mark", "words", F.explode("places").alias("place")).select("doc_id", "mark", F.expr("words[place]").alias("w"))
    start = F.col("w.start") + F.length("w.value") - F.length(F.ltrim("w.value", F.lit(MARKS)))
    return each.select("doc_id", "mark", start.alias("start"), (start + F.length(F.btrim("w.value", F.lit(MARKS)))).alias("end")).distinct()


def _listed(kind: Column | str, spans: Column) -> Column:
    name = F.lit(kind)
    return F.transform(spans, lambda s: F.concat_ws(":", name, s["start"].cast("string"), s["end"].cast("string")))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each fixed kind, base_sha256 and all spans of every row."""
    found = stored(scanned(docs))
    more = bootstrapped(found)
    rows = found.drop("text")
    if more is None:
        rows = rows.withColumn(CONTEXT, F.lit(None).cast("array<struct<start:int,end:int>>"))
    else:
        more = more.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
            F.array_sort(F.collect_set(F.struct("start", "end"))).alias(CONTEXT)
        )
        rows = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("mark").eqNullSafe(F.col("_mark")), "left")
    base = F.concat(*[_listed(kind, F.col(kind)) for kind in KINDS])
    extra = F.coalesce(_listed(CONTEXT, F.col(CONTEXT)), F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, extra), ",").alias("spans"),
    )
