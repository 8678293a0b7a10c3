"""Helpers that depend on the session: shared storage and joins of signal with metadata."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a broadcast may hold, by the measured width of its rows.
BROADCAST_MAX_BYTES = 32 << 20
# Parts that the blocks of one run are dealt to when they meet a table too large to broadcast.
SALTS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if configured:
        if configured.startswith("file:") and not local:
            raise ValueError("spark.checkpoint.dir must be a folder shared by all executors, not a local one")
        return configured.rstrip("/")
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="spark-")


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    def remove() -> None:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table in the shared folder; it is removed when the driver ends with a running session."""
    folder = f"{shared_dir(spark)}/leadwave-{uuid.uuid4().hex}"
    _remove_at_exit(spark, folder)
    return f"{folder}/{name}"


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint a metadata table in the shared folder, so that it is computed once and survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def is_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether a table's rows take no more than `max_bytes`. Rows are counted up to the bound, and their texts measured."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    width = sum(texts, F.lit(16 * len(df.columns)))
    rows = df.select(width.cast("bigint").alias("width")).limit(max_bytes // (16 * len(df.columns)) + 1)
    return (rows.agg(F.sum("width")).first()[0] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Mark a metadata table for broadcast when its measured size is within the bound; else the join shuffles."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def join_spread(blocks: DataFrame, table: DataFrame, on: list[str], along: str = "block_idx") -> DataFrame:
    """Join on `on` and a part of `along`: the rows of one key lie in SALTS partitions, where each has a copy of the key's metadata."""
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    left = blocks.withColumn("_part", F.pmod(F.col(along).cast("bigint"), F.lit(SALTS).cast("bigint")))
    return left.join(table.withColumn("_part", parts), [*on, "_part"]).drop("_part")


def join_metadata(blocks: DataFrame, table: DataFrame, on: list[str], along: str = "block_idx") -> DataFrame:
    """Join blocks of signal with a table of their runs or channels: a broadcast within the bound, beyond it join_spread, so
    that no plan brings a whole recording, or one channel of it, to one partition."""
    return blocks.join(F.broadcast(table), on) if is_small(table) else join_spread(blocks, table, on, along)
