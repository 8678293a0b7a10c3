"""Parquet tables of signals, electrodes and results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadwave import schema as S
from leadwave.operators.blocks import slice_samples
from leadwave.session import broadcast_if_small

#: Tables that `store` writes as generations.
GENERATIONS = ("band_power", "bipolar_electrodes", "sessions")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def table_exists(spark: SparkSession, root: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def scan_signals(signals: DataFrame, series_name: str = S.SERIES_NAME) -> DataFrame:
    """One named series, whole."""
    return signals.where(F.col("series_name") == series_name)


def scan_signal_slice(
    signals: DataFrame, start: int, end: int, n_channels: int | None = None,
    series_name: str = S.SERIES_NAME, block_len: int | None = None,
) -> DataFrame:
    """Samples [start, end) of a series, optionally of the first channels; the filters reach the scan."""
    series = scan_signals(signals, series_name)
    if n_channels is not None:
        series = series.where(F.col("channel_pos") < n_channels)
    return slice_samples(series, start, end, block_len)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Every attempt at a run, as `store` recorded it; no rows where nothing was stored yet."""
    if not table_exists(spark, root, "status"):
        return spark.createDataFrame([], S.LEDGER)
    return spark.read.schema(S.LEDGER).parquet(f"{root.rstrip('/')}/status")


def read_status(spark: SparkSession, root: str) -> DataFrame:
    """The last attempt at each run; a ledger row is metadata of a whole recording."""
    last = F.max_by(F.struct(*S.LEDGER.fieldNames()), F.struct("committed_at", "generation")).alias("last")
    return read_ledger(spark, root).groupBy("run_id").agg(last).select("last.*")


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as `store` left it: of each run the rows of its last attempt, if that succeeded.

    Rows of a write that was broken off are in no ledger row, and what was replaced is not in the last one; both are left out by
    their folders. A table written without generations is read as it is.
    """
    found = read_table(spark, root, name)
    if "generation" not in found.columns:
        return found
    # Ids are text, whatever they look like in a folder's name.
    fields = [T.StructField(f.name, T.StringType() if f.name in ("run_id", "generation") else f.dataType) for f in found.schema.fields]
    stored = spark.read.schema(T.StructType(fields)).parquet(f"{root.rstrip('/')}/{name}")
    current = read_status(spark, root).where("status = 'succeeded'").select("run_id", "generation")
    return stored.join(broadcast_if_small(current), ["run_id", "generation"], "left_semi").select(*(c for c in found.columns if c != "generation"))


def scan_band_power(spark: SparkSession, root: str) -> DataFrame:
    return read_committed(spark, root, "band_power").select(*S.BAND_POWER.fieldNames())


def bands_table(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "bands")


def band_limits_map(bands: DataFrame) -> DataFrame:
    """Names, limits and the name -> limits map in band order; the table has a row per band."""
    rows = F.array_sort(F.collect_list(F.struct("band_idx", "band", "fmin", "fmax")))
    limits = F.transform("rows", lambda r: F.struct(r["band"], F.struct(r["fmin"].alias("fmin"), r["fmax"].alias("fmax"))))
    return bands.agg(rows.alias("rows")).select(
        F.col("rows.band").alias("names"),
        F.transform("rows", lambda r: F.array(r["fmin"], r["fmax"])).alias("limits"),
        F.map_from_entries(limits).alias("band_limits"),
    )


def _replace_runs(df: DataFrame, root: str, name: str) -> None:
    """Put a table's runs in the place of those that count by the ledger; runs without a result get a generation and a ledger row."""
    spark, new = df.sparkSession, new_generation()
    current = read_status(spark, root).where("status = 'succeeded'").select("run_id", "generation")
    placed = df.join(broadcast_if_small(current), "run_id", "left").withColumn("generation", F.coalesce("generation", F.lit(new)))
    writer = placed.hint("rebalance", "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("generation", "run_id").parquet(f"{root.rstrip('/')}/{name}")
    folder = f"{name}/generation={new}"
    if table_exists(spark, root, folder):
        named = spark.read.schema("run_id string").parquet(f"{root.rstrip('/')}/{folder}").distinct()
        append_ledger(named.select("run_id", F.lit("succeeded").alias("status"), F.lit(new).alias("generation")), root)


def new_generation() -> str:
    return f"g-{uuid.uuid4().hex}"


def append_ledger(rows: DataFrame, root: str) -> None:
    """Record attempts, in one file, so that all of them come to count at once."""
    stamped = rows.withColumn("committed_at", F.current_timestamp())
    absent = lambda f: F.col(f.name) if f.name in stamped.columns else F.lit(None)
    ledger = stamped.select(*(absent(f).cast(f.dataType).alias(f.name) for f in S.LEDGER.fields))
    ledger.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/status")


def write_by_run(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Write a table partitioned by run, replacing only the runs it holds, also where `store` has written generations.

    The rebalance hint gives files of even size: small runs share a task, a huge run is split.
    """
    if name in GENERATIONS and table_exists(df.sparkSession, root, "status"):
        return _replace_runs(df, root, name)
    writer = df.hint("rebalance", "run_id").write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(f"{root.rstrip('/')}/{name}")


def write_generation(df: DataFrame, root: str, name: str, generation: str) -> None:
    """Write a table's rows beside those of earlier generations, which stay as they are; read_committed tells which count."""
    writer = df.withColumn("generation", F.lit(generation)).hint("rebalance", "run_id").write.mode("append")
    writer.partitionBy("generation", "run_id").parquet(f"{root.rstrip('/')}/{name}")


def write_signals(signals: DataFrame, root: str) -> None:
    write_by_run(signals, root, "signals")


def write_band_power(band_power: DataFrame, root: str) -> None:
    write_by_run(band_power, root, "band_power")


def write_bipolar_electrodes(table: DataFrame, root: str) -> None:
    """Pair table with all its columns; pair_idx is the region 0..n-1 the band power refers to."""
    write_by_run(table, root, "bipolar_electrodes")


def write_bands(spark: SparkSession, root: str, bands: dict = S.BANDS) -> None:
    S.bands_frame(spark, bands).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/bands")


def save_signals_bucketed(signals: DataFrame, table: str, buckets: int) -> None:
    """Store signals so that all channels of a run's block lie in one bucket.

    bipolar_subtract on the table then needs no shuffle of the signal.
    """
    signals.write.mode("overwrite").bucketBy(buckets, "run_id", "block_idx").sortBy("channel_pos").saveAsTable(table)
