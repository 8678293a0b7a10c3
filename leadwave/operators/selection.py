"""Selections of time and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadwave.functions.timeaxis import whole_samples
from leadwave.operators.blocks import series_key, slice_samples
from leadwave.session import join_metadata

# Pairs looked at when a recording is checked by eye.
CHECKED_PAIRS = [0, 10, 50, 100, 150]


def segment_bounds(recordings: DataFrame, duration_min: float = 5.0, segment: str = "middle") -> DataFrame:
    """Per run: sample range [seg_start, seg_end) of the first, middle or last minutes."""
    length = F.least(whole_samples(duration_min * 60, F.col("sfreq")), F.col("n_samples"))
    rest = F.col("n_samples") - length
    starts = {
        "start": F.lit(0).cast("bigint"),
        "middle": F.call_function("div", rest, F.lit(2).cast("bigint")),
        "end": rest,
    }
    if segment not in starts:
        raise ValueError("segment must be 'start', 'middle' or 'end'")
    first = starts[segment]
    return recordings.select(*series_key(recordings), first.alias("seg_start"), (first + length).alias("seg_end"))


def segment_select(blocks: DataFrame, recordings: DataFrame, duration_min: float = 5.0, segment: str = "middle") -> DataFrame:
    """The blocks of the chosen minutes, cut at their edges; each series has bounds of its own."""
    on = series_key(blocks, recordings)
    bounds = segment_bounds(recordings, duration_min, segment).select(*on, "seg_start", "seg_end")
    return slice_samples(join_metadata(blocks, bounds, on), F.col("seg_start"), F.col("seg_end")).drop("seg_start", "seg_end")


def first_n_channels(blocks: DataFrame, n: int, channel: str = "channel_pos") -> DataFrame:
    return blocks.where(F.col(channel) < n)


def channels_by_index(blocks: DataFrame, indices: list[int] = CHECKED_PAIRS, channel: str = "pair_idx") -> DataFrame:
    return blocks.where(F.col(channel).isin(list(indices)))


def channels_by_name(pairs: DataFrame, text: str, k: int = 5) -> DataFrame:
    """First k pairs of each run whose label contains a text."""
    order = Window.partitionBy("run_id").orderBy("pair_idx")
    named = pairs.where(F.col("location").contains(text)).select("run_id", "pair_idx", "location")
    return named.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def shaft_select(raw: DataFrame, bipolar: DataFrame, channels: DataFrame, pairs: DataFrame, shaft: str) -> DataFrame:
    """Raw channels and pairs of one shaft side by side, tagged by kind.

    channels: run_id, channel_pos, shaft, location of the electrodes.
    """
    chosen = channels.where(F.col("shaft") == shaft).select("run_id", "channel_pos", "location")
    paired = pairs.where(F.col("shaft") == shaft).select("run_id", "pair_idx")
    layout = ("block_idx", "start_sample", "samples")
    left = join_metadata(raw, chosen, ["run_id", "channel_pos"]).select(
        F.lit("raw").alias("kind"), "run_id", F.col("channel_pos").alias("trace_idx"), "location",
        *layout[:2], F.col("samples").cast("array<double>").alias("samples"),
    )
    right = join_metadata(bipolar, paired, ["run_id", "pair_idx"]).select(
        F.lit("bipolar").alias("kind"), "run_id", F.col("pair_idx").alias("trace_idx"), "location", *layout
    )
    return left.unionByName(right)
