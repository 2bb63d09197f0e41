"""Joins of many rows with a table of at most one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16
HOT_KEYS = 256  # a key is hot that more than one of so many rows has, so there are fewer than that
COUNTERS = 8192  # of the sketch that finds them


def measured_bytes(df: DataFrame) -> int:
    """Size of a table's values, by one aggregation over it.

    Counts the bytes of every text and 16 for any other value.
    """
    sizes = [
        F.coalesce(F.octet_length(f.name), F.lit(0)) + 8
        if isinstance(f.dataType, T.StringType)
        else F.lit(16)
        for f in df.schema
    ]
    return df.agg(F.sum(sum(sizes, F.lit(0)).cast("bigint"))).first()[0] or 0


def frequent_keys(rows: DataFrame, on: Sequence[str], most: int = HOT_KEYS) -> list[int]:
    """Hashes of the keys that more than one of ``most`` rows has, rows without a key included.

    A frequent-items sketch of the key's hash: each task keeps a bounded list of counters, the lists are merged, and
    at most ``most`` pairs of numbers reach the driver. Its counts err by less than 4 rows in ``COUNTERS``, and keys
    near the limit may be found or not; that changes how rows are spread, not which.
    """
    keys = rows.select(F.xxhash64(*on).alias("key"))
    sketch = F.expr(f"approx_top_k(key, {most}, {COUNTERS})")
    found = keys.agg(F.count(F.lit(1)).alias("rows"), sketch.alias("top")).first()
    return [item["item"] for item in found["top"] or [] if item["count"] * most > found["rows"]]


def lookup_join(
    rows: DataFrame,
    keyed: DataFrame,
    on: Sequence[str],
    how: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join rows with ``keyed``, which has one row per key ('left' or 'left_semi').

    ``keyed`` is stored and its size measured. A small one is broadcast, and the rows stay where they are. With a larger
    one, keys that many rows have (see :func:`frequent_keys`) are copied once per salt and their rows spread over the
    salts, rows without a key likewise; all other keys are joined as they are, without copies. Every row still meets its match exactly once.

    The salt is a hash of the row's own values, the same whenever a task runs
    again. Floating-point values are left out of it: sums of them depend on
    the order of the additions. Finding the frequent keys is a pass of its own over the key columns
    of ``rows``; store rows first that are expensive to make.
    """
    keyed = materialize(keyed)
    if measured_bytes(keyed) <= broadcast_bytes:
        joined = rows.join(F.broadcast(keyed), list(on), how)
    elif not (hot := frequent_keys(rows, on, hot_keys)):
        joined = rows.join(keyed.hint("merge"), list(on), how)
    else:
        left, right = salted(rows, keyed, on, hot, salts)
        joined = left.join(right.hint("merge"), [*on, "_salt"], how)
    added = [c for c in keyed.columns if c not in on] if how == "left" else []
    return joined.select(*rows.columns, *added)


def salted(
    rows: DataFrame, keyed: DataFrame, on: Sequence[str], hot: Sequence[int], salts: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt``, 0 but for the frequent keys: any salt on one side, all of them on the other."""
    frequent = F.xxhash64(*on).isin(list(hot))
    exact = (T.StringType, T.IntegralType, T.TimestampType, T.BooleanType)
    stable = [f.name for f in rows.schema if isinstance(f.dataType, exact)]
    own = F.pmod(F.xxhash64(*stable), F.lit(salts)).cast("int")
    every = F.when(frequent, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("_salt", F.when(frequent, own).otherwise(0))
    return left, keyed.withColumn("_salt", F.explode(every))
