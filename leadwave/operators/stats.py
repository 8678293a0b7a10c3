"""Statistics of signals and band power."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwave.functions.timeaxis import whole_samples
from leadwave.operators.blocks import cut_pieces, series_key
from leadwave.session import join_metadata, join_spread

NAN = float("nan")


def _min(value: Column) -> Column:
    """Minimum that is NaN when any value is, like the maximum and the mean."""
    return F.when(F.bool_or(F.isnan(value)), F.lit(NAN)).otherwise(F.min(value))


def block_moments(blocks: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """One row per block: number of samples, their mean, sum of squared distances from it, least and greatest value.

    They are taken inside the array, so no row stands for a sample; NULL samples are counted only. NaN samples make all but the
    number NaN.
    """
    held = F.array_compact(F.col("samples").cast("array<double>"))
    if scale != 1.0:
        held = F.transform(held, lambda x: x * F.lit(scale))
    rows = blocks.where(F.size("samples") > 0).select(*keys, F.size("samples").cast("bigint").alias("n"), held.alias("held"))
    rows = rows.withColumn("known", F.size("held").cast("bigint"))
    rows = rows.withColumn("mean", F.when(F.col("known") > 0, F.aggregate("held", F.lit(0.0), lambda s, x: s + x) / F.col("known")))
    far = F.aggregate("held", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    high = F.array_max("held")
    low = F.when(F.isnan(high), F.lit(NAN)).otherwise(F.array_min("held"))
    return rows.select(*keys, "n", "known", "mean", F.when(F.col("known") > 0, far).alias("m2"), low.alias("low"), high.alias("high"))


def merge_moments(moments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, var, low, high) of all rows of a key: squares within the rows and, once the mean of all is known, between them.

    Only rows of moments are shuffled, once: the mean of a key is a window over the partition its sums are taken in.
    """
    key = Window.partitionBy(*keys)
    centre = F.sum(F.col("known") * F.col("mean")).over(key) / F.sum("known").over(key)
    apart = F.col("m2") + F.col("known") * (F.col("mean") - F.col("_centre")) ** 2
    return moments.withColumn("_centre", centre).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("_centre").alias("mean"), (F.sum(apart) / F.sum("known")).alias("var"),
        _min(F.col("low")).alias("low"), F.max("high").alias("high"),
    )


def signal_stats(blocks: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """min, max, mean, population std and peak-to-peak of the samples per key; scale 1e6 gives microvolt."""
    stats = merge_moments(block_moments(blocks, keys, scale), keys)
    return stats.select(
        *keys, "n", F.col("low").alias("min"), F.col("high").alias("max"), "mean", F.sqrt("var").alias("std"),
        (F.col("high") - F.col("low")).alias("range"),
    )


def channel_std(blocks: DataFrame, keys: list[str], scale: float = 1e6) -> DataFrame:
    return merge_moments(block_moments(blocks, keys, scale), keys).select(*keys, F.sqrt("var").alias("std"))


def channel_moments(blocks: DataFrame, channel: str) -> DataFrame:
    """One row per channel of a series: count, mean, variance, lowest and highest sample."""
    keys = [*series_key(blocks), channel]
    return merge_moments(block_moments(blocks, keys), keys)


def pool_moments(moments: DataFrame, channel: str) -> DataFrame:
    """Add the std over all samples of the series and the channel's rank from 0, without another scan."""
    run = Window.partitionBy(*series_key(moments))
    total = F.sum("n").over(run)
    centred = moments.withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(run) / total)
    spread = F.sum(F.col("n") * (F.col("var") + (F.col("mean") - F.col("_mean")) ** 2)).over(run)
    rank = F.row_number().over(run.orderBy(channel)) - 1
    return centred.withColumns({"std": F.sqrt(spread / total), "rank": rank}).drop("_mean")


def trace_layout(blocks: DataFrame, channel: str = "channel_pos", gap: float = 4.0) -> DataFrame:
    """Vertical offset of each trace: its rank in the selection times gap times the std of all samples.

    The samples are reduced to one row per channel first; the rest works on those rows.
    """
    offset = F.col("rank") * F.col("std") * F.lit(gap)
    return pool_moments(channel_moments(blocks, channel), channel).select(
        *series_key(blocks), channel, "rank", offset.alias("offset"),
        (F.col("low") + offset).alias("trace_low"), (F.col("high") + offset).alias("trace_high"),
        "low", "high", "std",
    )


def raw_vs_bipolar_ratio(raw: DataFrame, bipolar: DataFrame) -> DataFrame:
    """Per series: std and range ratio, the larger range and common limits of the stacked traces."""
    on = series_key(raw, bipolar)
    sides = []
    for name, blocks, channel in (("raw", raw, "channel_pos"), ("bipolar", bipolar, "pair_idx")):
        sides.append(
            trace_layout(blocks, channel).groupBy(*on).agg(
                F.max("std").alias(f"{name}_std"),
                (F.max("high") - _min(F.col("low"))).alias(f"{name}_range"),
                _min(F.col("trace_low")).alias(f"{name}_low"),
                F.max("trace_high").alias(f"{name}_high"),
            )
        )
    return sides[0].join(sides[1], on).select(
        *on,
        (F.col("bipolar_std") / F.col("raw_std")).alias("std_ratio"),
        (F.col("bipolar_range") / F.col("raw_range")).alias("range_ratio"),
        F.greatest("raw_range", "bipolar_range").alias("max_range"),
        F.least("raw_low", "bipolar_low").alias("axis_low"),
        F.greatest("raw_high", "bipolar_high").alias("axis_high"),
    )


def _window_moments(blocks: DataFrame, recordings: DataFrame, seconds: float, keys: list[str]) -> DataFrame:
    """std of every full window of a number of seconds of a series; the remainder of a channel is left out.

    Blocks are cut at the windows' edges where they lie, and only the moments of the pieces are shuffled.
    """
    on = series_key(blocks, recordings)
    keys = [*keys, *(c for c in on if c not in keys)]
    sized = recordings.select(*on, "sfreq", whole_samples(seconds, F.col("sfreq")).alias("window_len"))
    joined = join_metadata(blocks.select(*keys, "block_idx", "start_sample", "samples"), sized, on)
    pieces = cut_pieces(joined, [*keys, "sfreq", "window_len"], F.col("window_len")).withColumnRenamed("block_idx", "window_idx")
    window = [*keys, "sfreq", "window_len", "window_idx"]
    full = merge_moments(block_moments(pieces, window), window).where(F.col("n") == F.col("window_len"))
    return full.select(*window, F.sqrt("var").alias("std"))


def _pair_keys(blocks: DataFrame) -> list[str]:
    return [*series_key(blocks), "pair_idx", "location"]


def window_std(blocks: DataFrame, recordings: DataFrame, window_sec: float = 60.0, keys: Sequence[str] | None = None) -> DataFrame:
    """std in full windows with the window centre in minutes, for each pair of each series unless `keys` say otherwise."""
    keys = list(keys or _pair_keys(blocks))
    centre = (F.col("window_idx") + F.lit(0.5)) * F.col("window_len") / F.col("sfreq") / 60
    return _window_moments(blocks, recordings, window_sec, keys).select(
        *keys, "window_idx", centre.alias("time_min"), "std"
    )


def exact_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per key without bringing all values of a key together; NaN if any value is.

    An approximate bracket around the middle comes first; values outside it only matter by their
    number, so they collapse to one row below and one above before the exact step.
    """
    v = F.col(value)
    bracket = F.percentile_approx(value, F.array(F.lit(0.499), F.lit(0.501)), F.lit(10_000))
    bounds = values.groupBy(*keys).agg(bracket.alias("bracket"), F.bool_or(F.isnan(v)).alias("spoiled"))
    clipped = (
        F.when(v < F.col("bracket")[0], F.lit(float("-inf")))
        .when(v > F.col("bracket")[1], F.lit(float("inf")))
        .otherwise(v)
    )
    counted = (
        values.select(*keys, value)
        .join(bounds, keys)
        .groupBy(*keys, "spoiled", clipped.alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    median = F.percentile("v", F.lit(0.5), F.col("n"))
    return counted.groupBy(*keys).agg(F.when(F.bool_or("spoiled"), F.lit(NAN)).otherwise(median).alias("median"))


def dropout_detect(
    blocks: DataFrame, recordings: DataFrame, window_sec: float = 60.0, ratio: float = 0.1, keys: Sequence[str] | None = None
) -> DataFrame:
    """Windows whose std is below ratio times the median window std of their channel.

    A channel with a NaN window has no median to compare with, so none of its windows is listed.
    """
    keys = list(keys or _pair_keys(blocks))
    stds = window_std(blocks, recordings, window_sec, keys)
    medians = exact_median(stds, list(keys), "std")
    half = F.lit(window_sec / 120.0)
    below = ~F.isnan("median") & (F.col("std") < F.col("median") * F.lit(ratio))
    return stds.join(medians, list(keys)).where(below).select(
        *keys, "window_idx", "time_min", "std", "median",
        (F.col("time_min") - half).alias("span_start_min"), (F.col("time_min") + half).alias("span_end_min"),
    )


def dropout_counts(dropouts: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return dropouts.groupBy(*(keys or _pair_keys(dropouts))).agg(F.count(F.lit(1)).alias("n_dropouts"))


def segment_flatness(blocks: DataFrame, recordings: DataFrame, segment_sec: float = 600.0, tol: float = 1e-10) -> DataFrame:
    """Per full segment: mean over channels of the std, and the number of flat channels."""
    keys = series_key(blocks)
    stds = _window_moments(blocks, recordings, segment_sec, [*keys, "pair_idx"])
    return stds.groupBy(*keys, "sfreq", "window_len", F.col("window_idx").alias("segment_idx")).agg(
        F.avg("std").alias("mean_std"),
        F.count_if(F.col("std") < F.lit(tol)).alias("zero_channels"),
        F.count(F.lit(1)).alias("n_channels"),
    ).select(
        *keys, "segment_idx",
        (F.col("segment_idx") * F.col("window_len") / F.col("sfreq") / 60).alias("start_min"),
        ((F.col("segment_idx") + 1) * F.col("window_len") / F.col("sfreq") / 60).alias("end_min"),
        "mean_std", "zero_channels", "n_channels",
    )


def band_stats(band_power: DataFrame) -> DataFrame:
    """Per run and band: mean, population std, min and max over windows and channels."""
    p = F.col("power")
    return band_power.groupBy("run_id", "band").agg(
        F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), _min(p).alias("min"), F.max(p).alias("max")
    )


def quality_flags(band_power: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Per run: any undefined value, any infinity, all values within tol of zero."""
    p = F.col("power")
    undefined = p.isNull() | F.isnan(p)
    return band_power.groupBy("run_id").agg(
        F.bool_or(undefined).alias("has_nan"),
        F.bool_or(F.coalesce(F.abs(p) == F.lit(float("inf")), F.lit(False))).alias("has_inf"),
        F.bool_and(F.coalesce((F.abs(p) <= F.lit(tol)) & ~F.isnan(p), F.lit(False))).alias("all_zero"),
    )


def tail_windows(band_power: DataFrame, fraction: int = 3) -> DataFrame:
    """Windows from index n // fraction on, n being the number of windows of the run.

    Best of stored band power, which is read twice. The counts have a row a run; Spark learns their size when they are there.
    """
    counts = band_power.groupBy("run_id").agg((F.max("bin_idx") + 1).alias("n_bins"))
    first = F.call_function("div", F.col("n_bins"), F.lit(fraction))
    return join_spread(band_power, counts, ["run_id"], "bin_idx").where(F.col("bin_idx") >= first).drop("n_bins")


def output_rate(band_power: DataFrame, bin_sec: float | None = None) -> DataFrame:
    """Rate from the first two window times per run; a single bin falls back to 1 / bin_sec."""
    first = band_power.where(F.col("bin_idx") < 2).groupBy("run_id").agg(
        F.max(F.when(F.col("bin_idx") == 0, F.col("time_sec"))).alias("t0"),
        F.max(F.when(F.col("bin_idx") == 1, F.col("time_sec"))).alias("t1"),
    )
    alone = F.lit(None).cast("double") if bin_sec is None else F.lit(1.0 / bin_sec)
    return first.select("run_id", F.coalesce(F.lit(1.0) / (F.col("t1") - F.col("t0")), alone).alias("rate"))
