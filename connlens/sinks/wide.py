"""Histories with a column per host, for any number of hosts: files of bounded width, and a reader that puts them together.

The values are dealt into blocks by hash, and numbered in each. One pivot by these numbers makes the rows of all blocks; a block's
own rows are then copied to its files under the names of its values. ``manifest`` tells the block of each value and is
written last, so a set without it is not complete. The driver holds the values of ``AT_ONCE`` blocks at a time. The reader
is one job over the files of all blocks, so its plan has the same size for any number of them.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import lookup_join, sum_counts
from ..session import materialize, scratch_folder

WIDTH = 1000
MANIFEST = "manifest"
AT_ONCE = 16  # small jobs that copy a block each
CELLS = 4_000_000  # of a file at most, so that a reading task can hold it


def _block_path(path: str, block: int) -> str:
    return f"{path.rstrip('/')}/block-{block:06d}"


def _block_of(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _dealt(values: DataFrame, column: str, width: int) -> int:
    """The number of blocks with which none has more than ``width`` values."""
    blocks = max(1, -(-values.count() // width))
    while True:
        sizes = values.groupBy(_block_of(column, blocks).alias("block")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= width:
            return blocks
        blocks = blocks + max(1, blocks // 4)


def write_wide(long: DataFrame, column: str, path: str, width: int = WIDTH) -> int:
    """Write a history (TS, a column, COUNT) as Parquet files with a column per value, at most ``width`` in a file.

    Returns the number of blocks. Values are written as text, a missing one as ``null``. A set that is there is replaced.
    """
    if column in ("TS", "COUNT") or width < 1:
        raise ValueError(f"cannot spread {column!r} over files of {width} columns")
    text = materialize(long.select("TS", F.coalesce(F.col(column).cast("string"), F.lit("null")).alias(column), "COUNT"))
    values = materialize(text.select(column).distinct())
    blocks = _dealt(values, column, width)
    manifest = values.withColumn("block", _block_of(column, blocks))
    place = F.row_number().over(Window.partitionBy("block").orderBy(column)) - 1
    placed = lookup_join(text, manifest.withColumn("place", place), [column], "left")
    most = manifest.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    cells = placed.groupBy("block", "TS").pivot("place", list(range(most))).agg(sum_counts())
    rows = scratch_folder(long.sparkSession)
    cells.repartitionByRange("block", "TS").sortWithinPartitions("block", "TS").write.partitionBy("block").parquet(rows)
    _clear(long.sparkSession, path)
    names = manifest.groupBy("block").agg(F.sort_array(F.collect_list(column)).alias("names"))
    if most:
        _copy_blocks(names, f"{rows}/block=", T.StructType([f for f in cells.schema if f.name != "block"]), path)
    manifest.write.parquet(f"{path.rstrip('/')}/{MANIFEST}")
    return blocks


def _copy_blocks(names: DataFrame, rows: str, schema: T.StructType, path: str) -> None:
    """Write the rows of every block under the names of its values, some blocks side by side."""
    spark = names.sparkSession

    def copy(row) -> None:
        own = spark.read.schema(T.StructType(schema[: len(row["names"]) + 1])).parquet(f"{rows}{row['block']}")
        wide = own.toDF("TS", *row["names"])
        # The rows of one file are in order of time already.
        wide = wide if len(own.inputFiles()) == 1 else wide.orderBy("TS")
        records = max(1, CELLS // len(row["names"]))
        wide.write.option("maxRecordsPerFile", records).parquet(_block_path(path, row["block"]))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for some in batched(names.toLocalIterator(), AT_ONCE):
            list(pool.map(inheritable_thread_target(spark)(copy), some))


def _clear(spark: SparkSession, path: str) -> None:
    """Remove a set, its manifest first."""
    jvm = spark.sparkContext._jvm
    for target in (f"{path.rstrip('/')}/{MANIFEST}", path):
        folder = jvm.org.apache.hadoop.fs.Path(target)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_wide(
    spark: SparkSession, path: str, column: str, values: Sequence[str] | None = None
) -> DataFrame:
    """The history in long form (TS, the column, COUNT), of some values or of all.

    Only the blocks that have one of the values are opened, and only their columns decoded.
    """
    manifest = spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}")
    if values is not None:
        manifest = manifest.where(F.col(column).isin(list(values)))
    blocks = [row["block"] for row in manifest.select("block").distinct().orderBy("block").collect()]
    if not blocks:
        return spark.createDataFrame([], f"TS timestamp, {column} string, COUNT bigint")
    wide = spark.read.parquet(_block_path(path, blocks[0])).schema
    count = next(f for f in wide if f.name != "TS").dataType
    schema = T.StructType([wide["TS"], T.StructField(column, T.StringType()), T.StructField("COUNT", count)])
    kinds = to_arrow_schema(schema)
    wanted = None if values is None else set(values)

    # All of it in here, so that workers need not have this package.
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                file = pq.ParquetFile(io.BytesIO(content.as_buffer()), coerce_int96_timestamp_unit="us")
                names = [n for n in file.schema_arrow.names if n != "TS" and (wanted is None or n in wanted)]
                for group in range(file.num_row_groups):
                    part = file.read_row_group(group, columns=["TS", *names])
                    rows = []
                    for name in names:
                        held = part.column(name).is_valid()
                        counts = part.column(name).filter(held)
                        rows.append(pa.table([part.column("TS").filter(held), pa.repeat(name, len(counts)), counts], names=kinds.names))
                    if rows:
                        yield from pa.concat_tables(rows).cast(kinds).combine_chunks().to_batches()

    files = spark.read.format("binaryFile").load([_block_path(path, b) for b in blocks])
    return files.select("content").mapInArrow(run, schema)
