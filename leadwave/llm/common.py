"""What the text operators share: tables in the shared folder, running offsets, Arrow columns."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadwave.session import scratch_path

# Documents are handed to NumPy in pieces of about this many bytes, which bounds a Python worker's arrays.
CHUNK_BYTES = 1 << 20


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work tables written inside are removed at the end, but for those written with keep=True, which belong to the scope around."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for folder in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table once to the folder all executors share and read it back: computed once, without lineage.

    What was shuffled for it is garbage then; the driver's collector is called so that Spark removes those files now and
    not when the driver happens to run short of memory.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from: crc32 of the id as text is divisible by five. A missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def may_be_alike(n: Column, apart: Column, likeness: Fraction) -> Column:
    """Whether two sets of `n` elements together that differ in at least `apart` of them can have that Jaccard likeness."""
    return (n - apart) * (likeness.numerator + likeness.denominator) >= 2 * n * likeness.numerator


def running_offsets(counts: DataFrame, index: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """Sum of `value` over all smaller `index`, in two levels so that no task sees more than a block or the list of blocks."""
    blocked = counts.withColumn("__block", F.floor(F.col(index) / block))
    blocks = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy("__block").agg(F.sum(value).alias("__sum"))
    starts = starts.select("__block", F.coalesce(F.sum("__sum").over(blocks), F.lit(0)).alias("__block_start"))
    total = F.col("__block_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return blocked.join(starts, "__block").withColumn(out, total).drop("__block", "__block_start")


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; a missing text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` bytes; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)
