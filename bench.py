"""Headline timings as one JSON line.

Queries run on the tables of $BENCH_SF_DIR with $BENCH_CPUS threads. The `recording_*` entries process one
long recording: the embeddings table repeated $BENCH_TILES times as time frames at 1000 Hz.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from checks.queries import QUERIES
from leadwave.operators.blocks import blocks_from_frames, measure_recordings
from leadwave.operators.stats import channel_std, window_std
from leadwave.plans.pipeline import process
from leadwave.schema import SERIES_NAME
from leadwave.session import scratch_path
from leadwave.sources.tables import read_table, write_signals

HEADLINE = [
    "bipolar_pairs", "bipolar_table_averaged", "bipolar_subtract", "bandpower_welch", "bandpower_stft", "spectrogram",
    "process_welch", "process_stft", "process_stft_in_brain", "window_std", "dropout_detect", "band_stats", "bandpower_qc",
    "pending_runs", "signal_stats",
]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def timed(frame) -> float:
    started = time.time()
    frame().write.format("noop").mode("overwrite").save()
    return round(time.time() - started, 3)


def tiled_recording(spark: SparkSession, sf_dir: str, tiles: int):
    """Frames of one long recording: the embeddings over and over, each round with its own gain."""
    table = X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    length = table.agg((F.max("vec_id") + 1).alias("n")).scalar()
    spread = table.repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    rounds = spread.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    gain = (1 + F.col("round") % 7).cast("float")
    return rounds.select(
        F.lit("emb").alias("run_id"), F.lit(SERIES_NAME).alias("series_name"),
        (F.col("round") * length + F.col("vec_id")).alias("sample_idx"),
        F.transform("embedding", lambda x: x * gain).alias("frame"),
    )


def recording_timings(spark: SparkSession, sf_dir: str, tiles: int) -> dict[str, float]:
    root = scratch_path(spark, "bench")
    started = time.time()
    write_signals(blocks_from_frames(tiled_recording(spark, sf_dir, tiles), 10_000), root)
    result = {"recording_ingest": round(time.time() - started, 3)}
    signals = read_table(spark, root, "signals")
    runs = X.with_rate(measure_recordings(signals)).withColumn("sfreq", F.lit(1000.0))
    electrodes, channels = X.emb_electrodes(spark, sf_dir), X.emb_channel_map(spark, sf_dir)
    result["recording_welch"] = timed(lambda: process(signals, runs, electrodes, channels, "chunked")["band_power"])
    result["recording_stft"] = timed(lambda: process(signals, runs, electrodes, channels, "whole_file")["band_power"])
    result["recording_window_std"] = timed(lambda: window_std(signals, runs, 60.0, ("run_id", "channel_pos")))
    result["recording_channel_std"] = timed(lambda: channel_std(signals, ["run_id", "channel_pos"]))
    return result


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    tiles = int(os.environ.get("BENCH_TILES", "300"))
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bandpower_welch"](spark, sf_dir).count()
    times = {name: timed(lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    times |= recording_timings(spark, sf_dir, tiles)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
