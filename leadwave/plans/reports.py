"""Reports on stored band power and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwave.functions.timeaxis import axis_from_rate
from leadwave.operators.stats import band_stats, dropout_counts, dropout_detect, quality_flags, segment_flatness, tail_windows
from leadwave.session import broadcast_if_small, join_metadata


def bandpower_report(band_power: DataFrame, bands: DataFrame, rates: DataFrame) -> DataFrame:
    """Traces per channel and band with band limits, the stored time and the axis rebuilt from the rate."""
    rated = join_metadata(band_power, rates, ["run_id"], "bin_idx").join(broadcast_if_small(bands), "band")
    seconds = axis_from_rate(F.col("bin_idx"), F.col("rate"))
    return rated.select(
        "run_id", "pair_idx", "location", "band", "fmin", "fmax", "bin_idx", "time_sec",
        seconds.alias("axis_sec"), (seconds / 60).alias("axis_min"), "power",
    )


def window_axis_from_rate(band_power: DataFrame, rates: DataFrame) -> DataFrame:
    """Time axis of each run from its rate: seconds, minutes, duration and step. Starts at 0."""
    counts = band_power.groupBy("run_id").agg((F.max("bin_idx") + 1).alias("n_windows"))
    axis = counts.join(rates, "run_id").withColumn(
        "bin_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_windows") - 1))
    )
    seconds = axis_from_rate(F.col("bin_idx"), F.col("rate"))
    return axis.select(
        "run_id", "bin_idx", seconds.alias("time_sec"), (seconds / 60).alias("time_min"),
        (F.col("n_windows") / F.col("rate")).alias("duration_sec"), (F.lit(1.0) / F.col("rate")).alias("step_sec"),
    )


def bipolar_qc(
    blocks: DataFrame, recordings: DataFrame, window_sec: float = 60.0, segment_sec: float = 600.0, ratio: float = 0.1
) -> dict[str, DataFrame]:
    """Dropouts per pair, their count, and flat segments."""
    dropouts = dropout_detect(blocks, recordings, window_sec, ratio)
    return {
        "dropouts": dropouts,
        "dropout_counts": dropout_counts(dropouts),
        "segments": segment_flatness(blocks, recordings, segment_sec),
    }


def bandpower_qc(band_power: DataFrame, tol: float = 1e-8, fraction: int = 3) -> dict[str, DataFrame]:
    """Flags and statistics per band, of the whole result and of its later windows."""
    tail = tail_windows(band_power, fraction)
    return {
        "flags": quality_flags(band_power, tol),
        "stats": band_stats(band_power),
        "tail_flags": quality_flags(tail, tol),
        "tail_stats": band_stats(tail),
    }
