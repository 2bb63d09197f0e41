"""Exact deduplication by recipes of content-defined chunks.

A text without its white space is cut where its own characters say so, so equal
passages give equal chunks wherever they stand. Each chunk's content is moved once: to be made
distinct, which shows the identifiers (64-bit hashes) that stand for two contents. Those
alone get a number besides. A text's recipe is the ordered list of its chunks' identifiers,
and texts are equal when their recipes are; only recipes are moved for that.

DataFrame operations only. Null counts as empty; empty texts and texts of white space are
equal to each other. Extra columns are ignored. Of equal texts the row with the
most code points in the original stays, then the smallest doc_id, a null one last. Rows that
repeat the doc_id of the row that stays are kept with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored

BLANK = r"[\x20\x09-\x0D]+"
# A chunk ends after one of these, within the limits. About every 400 letters of European prose.
CUT = "[ao][nr][dt]"
LEAST, MOST = 256, 4096

Hash = Callable[[Column], Column]


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, "")


def chunks(text: Column) -> Column:
    """The text in pieces; joined, they give it back."""
    pattern = f"(?s).{{{LEAST},{MOST}}}?{CUT}|.{{1,{MOST}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clashes(docs: DataFrame, hashed: Hash) -> DataFrame:
    """id, chunk and number of the chunks whose identifier stands for several contents."""
    each = docs.select(F.explode(F.array_distinct(chunks(normalised()))).alias("chunk"))
    distinct = each.select(hashed(F.col("chunk")).alias("id"), "chunk").distinct()
    several = stored(distinct.groupBy("id").agg(F.count("*").alias("_k")).where("_k > 1").select("id"))
    if several.isEmpty():
        return several.select("id", F.lit("").alias("chunk"), F.lit(0).alias("number"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("chunk"))
    return stored(distinct.join(several, "id").select("id", "chunk", number.alias("number")))


def recipes(docs: DataFrame, hashed: Hash) -> DataFrame:
    """doc_id, n_chars, text_sha256 and the recipe: ``ids``, and ``numbers`` for identifiers that clash."""
    clash = clashes(docs, hashed)
    text = normalised()
    rows = docs.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.transform(chunks(text), lambda c: hashed(c)).alias("ids"),
    )
    none = F.array().cast("array<struct<at:int,number:int>>")
    if clash.isEmpty():
        return stored(rows.withColumn("numbers", none))
    parts = docs.select(F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.posexplode(chunks(text)).alias("at", "chunk"))
    parts = parts.withColumn("id", hashed(F.col("chunk"))).join(clash, ["id", "chunk"])
    parts = parts.select("text_sha256", "at", "number").distinct()
    numbers = parts.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("numbers"))
    return stored(rows.join(numbers, "text_sha256", "left").withColumn("numbers", F.coalesce("numbers", none)))


def duplicates(docs: DataFrame, hashed: Hash = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = recipes(docs, hashed)
    best = F.max(F.struct("n_chars", F.negative("doc_id").alias("least")))
    groups = rows.groupBy("ids", "numbers").agg(best.alias("_best"), F.count("*").alias("group_size"))
    found = rows.join(groups, ["ids", "numbers"])
    keep = F.negative(F.col("_best.least"))
    return found.select(
        "doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )
