"""A bitmap over hashed values that fits a fixed size, built by Spark and sent to all tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 23  # 2^23 bits: one megabyte, whatever the number of values


def bitmap_of(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bitmap of the lowest ``bits`` bits of a bigint column.

    At most 2^bits / 32 rows reach the driver. A value may be found that is not
    in the column, never the other way round; users must allow for that.
    """
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        df.where(F.col(column).isNotNull())
        .select(F.shiftright(low, 5).cast("int").alias("w"), low.bitwiseAND(F.lit(31)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    ).toArrow()
    words = np.zeros(1 << (bits - 5), dtype=np.uint32)
    words[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.uint32)
    return words


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values.astype(np.uint64) & np.uint64(len(words) * 32 - 1)
    return (words[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
