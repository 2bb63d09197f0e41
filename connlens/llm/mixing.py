"""Mixing sources to target weights by entropy balancing.

Every document gets a rate. Of all rates that give each source its target of
words, those nearest to one in entropy are exponentially tilted: the rate is
exp(l * size / mean size of the source), with one multiplier l per source,
and never over ``MOST``. The multipliers solve the convex dual. A Newton step on it is
a Spark aggregation over the counts of documents by source and size; a step that
would leave the known bracket halves the bracket instead. Rates are then rounded to
whole copies: every document gets the whole part, and those whose fraction is the
largest against a stable hash get one more, until the source has its words.

DataFrame operations only. A null text has size 0, as has one without words; it takes no
words and gets one copy. A null source is a source of its own, last in order. Extra
columns are ignored. Rows equal in doc_id and text get the same copies. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored

MOST = 3
WEIGHTS = (1.0, 2.0, 3.0)
WORD = r"[^\x20\x09-\x0D]+"
STEPS = 48  # Newton steps at most; about ten are needed
STEPS_STORED = 4  # steps of one Spark job
CLOSE = 1e-7  # relative error of a source's words at which the steps end
BINS = 1024  # of the rounding order, at each of two levels


def size_of(text: str = "text") -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _with(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join by source, null equal to null."""
    other = by_source.withColumnRenamed("source", "_source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def targets(counts: DataFrame) -> DataFrame:
    """source, source_size, target. ``counts`` has source, size and the number ``n`` of such documents.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at
    MOST times the source's size and the excess goes to the others by weight,
    so it is min(MOST * source_size, weight * level) with one level for all.
    The level comes from running sums over the sources, one row each, by MOST * size / weight.
    """
    by_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), number % len(WEIGHTS) + 1)
    weighed = by_source.withColumn("_w", weight).withColumn("_most", F.col("source_size").cast("double") * MOST)
    ratio = F.col("_most") / F.col("_w")
    everything, ranked = Window.partitionBy(), Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    # The level if all of smaller ratio stop at their limits and the others do not.
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levels = weighed.withColumn("_level", rest / open_weight).withColumn("_ratio", ratio)
    # It holds at the first source whose own limit is not below it.
    holds = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(everything)
    level = F.coalesce(holds["_level"], F.lit(0.0))
    return levels.select("source", "source_size", F.least(F.col("_most"), F.col("_w") * level).alias("target"))


def rate_of(multiplier: Column, x: Column) -> Column:
    """min(MOST, exp(multiplier * x)), without overflow."""
    limit = F.log(F.lit(float(MOST)))
    return F.when(multiplier * x >= limit, float(MOST)).otherwise(F.exp(F.least(multiplier * x, limit)))


def _step(counts: DataFrame, state: DataFrame) -> DataFrame:
    """One Newton step of every source."""
    rate = rate_of(F.col("l"), F.col("x"))
    free = F.col("l") * F.col("x") < F.log(F.lit(float(MOST)))
    words = F.col("n") * F.col("size") * rate
    carried = ["source", "target", "l", "low", "high"]
    sums = _with(counts, state).groupBy(*carried).agg(
        F.sum(words).alias("f"), F.sum(F.when(free, words * F.col("x")).otherwise(0.0)).alias("g")
    )
    over = F.col("f") > F.col("target")
    sums = sums.withColumns(
        {"low": F.when(over, F.col("low")).otherwise(F.col("l")), "high": F.when(over, F.col("l")).otherwise(F.col("high"))}
    )
    newton = F.col("l") - (F.col("f") - F.col("target")) / F.col("g")
    inside = (F.col("g") > 0) & (newton > F.coalesce("low", newton - 1)) & (newton < F.coalesce("high", newton + 1))
    outward = F.when(F.col("high").isNull(), F.abs("l") * 2 + 1).when(F.col("low").isNull(), -F.abs("l") * 2 - 1)
    halved = F.coalesce(outward, (F.col("low") + F.col("high")) / 2)
    done = F.abs(F.col("f") - F.col("target")) <= F.col("target") * CLOSE
    moved = F.when(done, F.col("l")).when(inside, newton).otherwise(halved)
    return sums.select("source", "target", moved.alias("l"), "low", "high", done.alias("done"))


def multipliers(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """source and multiplier ``l``, of the sources whose target is below their limit."""
    below = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * (MOST * (1 - CLOSE)))
    start = F.log(F.col("target") / F.col("source_size"))
    null = F.lit(None).cast("double")
    state = wanted.where(below).select("source", "target", start.alias("l"), null.alias("low"), null.alias("high"))
    for _ in range(STEPS // STEPS_STORED):
        for _ in range(STEPS_STORED):
            state = _step(counts, state.drop("done"))
        state = stored(state)
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "l")


def _tilted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rate, whole copies and rank value ``v`` of every row that has source, size and hash."""
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("l").isNull(), float(MOST)).otherwise(rate_of(F.col("l"), x))
    chance = F.col("hash").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return (
        _with(rows, plan)
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("v", F.when(F.col("whole") < MOST, chance - (F.col("rate") - F.col("whole"))))
    )


def mixing_plan(rows: DataFrame) -> DataFrame:
    """Per source: source_size, target, mean, l and the rank value ``cut`` up to which one copy more is taken.

    ``rows``: source, size and hash per document, stored.
    """
    counts = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    wanted = targets(counts)
    sized = counts.where("size > 0")
    means = sized.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    wanted = stored(_with(wanted, means, "left"))
    scaled = _with(sized, wanted.select("source", "mean")).withColumn("x", F.col("size") / F.col("mean"))
    solved = multipliers(scaled.select("source", "size", "n", "x"), wanted)
    plan = stored(_with(wanted, solved, "left"))

    docs = _tilted(rows.where("size > 0"), plan)
    whole = docs.groupBy("source", "target").agg(F.sum(F.col("whole") * F.col("size")).alias("_whole"))
    span = stored(whole.select("source", (F.col("target") - F.col("_whole")).alias("need"), F.lit(-1.0).alias("low"), F.lit(2.0).alias("width")))
    open_docs = docs.where(F.col("v").isNotNull()).select("source", "size", "v")
    for _ in range(2):
        inside = _with(open_docs, span).where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + F.col("width")))
        bins = inside.groupBy("source", "need", "low", "width", F.floor((F.col("v") - F.col("low")) / F.col("width") * BINS).alias("bin")).agg(
            F.sum("size").alias("words")
        )
        running = Window.partitionBy("source").orderBy("bin")
        full = bins.withColumn("_to", F.sum("words").over(running)).where(F.col("_to") - F.col("words") <= F.col("need"))
        last = full.groupBy("source", "need", "low", "width").agg(F.max(F.struct("bin", "_to", "words")).alias("_b"))
        width = F.col("width") / BINS
        span = stored(
            last.select(
                "source",
                (F.col("need") - (F.col("_b._to") - F.col("_b.words"))).alias("need"),
                (F.col("low") + F.col("_b.bin") * width).alias("low"),
                width.alias("width"),
            )
        )
    inside = _with(open_docs, span).where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + F.col("width")))
    running = Window.partitionBy("source").orderBy("v")
    steps = inside.withColumn("_to", F.sum("size").over(running))
    ends = steps.select("source", "v", F.abs(F.col("_to") - F.col("need")).alias("off"))
    none = span.select("source", (F.col("low") - 1e-12).alias("v"), F.abs("need").alias("off"))
    cut = ends.unionByName(none).groupBy("source").agg(F.min(F.struct("off", "v")).alias("_c"))
    return stored(_with(plan, cut.select("source", F.col("_c.v").alias("cut")), "left"))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of().alias("size"), F.xxhash64("doc_id", "text").alias("hash"))


def _copies() -> Column:
    return (F.col("whole") + F.when(F.col("v") <= F.col("cut"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate and copies of every document.

    ``taken`` is copies times size. A source's taken words miss its target by
    less than the size of one of its documents.
    """
    rows = stored(_measured(docs))
    tilted = _tilted(rows, mixing_plan(rows)).withColumn("copies", _copies())
    taken = (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    return tilted.select("doc_id", "size", "source_size", "target", taken, "rate", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents, each as often as its copies; all columns stay as they are."""
    plan = mixing_plan(stored(_measured(docs)))
    names = docs.columns
    kept = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    rows = docs.select("source", kept, size_of().alias("size"), F.xxhash64("doc_id", "text").alias("hash"))
    tilted = _tilted(rows, plan).withColumn("_n", _copies())
    repeated = tilted.where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return repeated.select("_row.*")
