"""Windows, bins, densities and band means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwave.functions.spectral import spectral_udf
from leadwave.functions.timeaxis import bin_center, hop_center, whole_samples
from leadwave.operators.blocks import RUN_SERIES, recut, series_key
from leadwave.schema import BANDS
from leadwave.session import broadcast_if_small, join_metadata

# Samples a re-cut block of hopping windows aims at; bounds the row, not the result.
HOP_BLOCK_SAMPLES = 60_000

SIGNAL_KEYS = ["run_id", "series_name", "pair_idx", "location"]


def welch_layout(
    recordings: DataFrame, nperseg: int | None = None, overlap: float = 0.5, bin_sec: float = 60.0
) -> DataFrame:
    """Per run: segment length, overlap and the bin length in samples. nperseg None means two seconds."""
    size = whole_samples(2.0, F.col("sfreq")) if nperseg is None else F.lit(nperseg).cast("bigint")
    return _layout(recordings, size, (size * F.lit(overlap)).cast("bigint"), whole_samples(bin_sec, F.col("sfreq")))


def hop_layout(
    recordings: DataFrame,
    nperseg: int = 500,
    overlap: float = 0.5,
    window_sec: float | None = None,
    overlap_sec: float | None = None,
) -> DataFrame:
    """Per run: window length and overlap, in samples or seconds, and blocks of whole steps.

    Each block is followed by the overlap of its last window, so that a window starts in exactly one
    block and ends within it.
    """
    size = F.lit(nperseg).cast("bigint") if window_sec is None else whole_samples(window_sec, F.col("sfreq"))
    shared = (size * F.lit(overlap)).cast("bigint") if overlap_sec is None else whole_samples(overlap_sec, F.col("sfreq"))
    step = F.greatest(size - shared, F.lit(1).cast("bigint"))
    steps = F.greatest(F.lit(1).cast("bigint"), F.call_function("div", F.lit(HOP_BLOCK_SAMPLES).cast("bigint"), step))
    return _layout(recordings, size, shared, step * steps, shared)


def _layout(recordings: DataFrame, nperseg: Column, noverlap: Column, block_len: Column, halo: Column | None = None):
    return recordings.select(
        *series_key(recordings),
        "n_samples",
        "sfreq",
        nperseg.alias("nperseg"),
        noverlap.alias("noverlap"),
        block_len.alias("block_len"),
        (F.lit(0).cast("bigint") if halo is None else halo).alias("halo"),
    )


def checked(layout: DataFrame) -> DataFrame:
    """The layout; a run whose overlap is not below its segment length is an error, not left out without a word."""
    message = F.concat(F.lit("run "), "run_id", F.lit(": overlap not below segment length"))
    sound = F.when(F.col("noverlap") < F.col("nperseg"), F.col("nperseg")).otherwise(F.raise_error(message).cast("bigint"))
    return layout.withColumn("nperseg", sound)


def relayout(blocks: DataFrame, layout: DataFrame) -> DataFrame:
    """Cut pair blocks to the layout of their run."""
    carried = [c for c in layout.columns if c not in (*RUN_SERIES, "n_samples", "block_len", "halo")]
    on = series_key(blocks, layout)
    joined = join_metadata(blocks, checked(layout).select(*on, *carried, "block_len", "halo"), on)
    return recut(joined, SIGNAL_KEYS + carried, F.col("block_len"), F.col("halo"))


def time_bins(blocks: DataFrame, recordings: DataFrame, bin_sec: float = 60.0) -> DataFrame:
    """Tumbling bins; the last one of a recording may be partial and is kept."""
    keys = [c for c in blocks.columns if c not in ("block_idx", "start_sample", "samples")]
    on = series_key(blocks, recordings)
    sized = recordings.select(*on, "sfreq", whole_samples(bin_sec, F.col("sfreq")).alias("block_len"))
    joined = join_metadata(blocks, sized, on)
    return recut(joined, keys + ["sfreq"], F.col("block_len")).withColumnRenamed("block_idx", "bin_idx")


def _spectral(laid: DataFrame, **options) -> Column:
    """The spectral step on blocks of one signal, or on blocks that still hold both contacts of a pair."""
    paired = "cathode_samples" in laid.columns
    arrays = ("samples", "cathode_samples") if paired else ("samples",)
    return spectral_udf(paired=paired, **options)(*arrays, "sfreq", "nperseg", "noverlap")


def _whole_windows(laid: DataFrame) -> DataFrame:
    """Rows that hold at least one window. A recording shorter than a window is one window of its length; one that is no longer
    than the overlap is an error."""
    size, first = F.size("samples").cast("bigint"), F.col("start_sample") == 0
    message = F.concat(F.lit("run "), "run_id", F.lit(": recording too short"))
    shared = F.when(first & (size <= F.col("noverlap")), F.raise_error(message).cast("bigint")).otherwise(F.col("noverlap"))
    return laid.where((size >= F.col("nperseg")) | first).withColumn("noverlap", shared)


def hop_segments(laid: DataFrame) -> DataFrame:
    """One row per hopping window, from blocks in hop_layout: only full windows."""
    size, step = F.col("nperseg"), F.col("nperseg") - F.col("noverlap")
    count = F.call_function("div", F.size("samples") - F.col("noverlap"), step)
    starts = F.sequence(F.lit(0).cast("bigint"), count - 1)
    pieces = F.transform(starts, lambda w: F.slice("samples", (w * step + 1).cast("int"), size.cast("int")))
    kept = laid.where(F.size("samples") >= size)
    return kept.select(
        *SIGNAL_KEYS, "sfreq", "nperseg", "noverlap", "start_sample", F.posexplode(pieces).alias("_w", "samples")
    ).select(
        *SIGNAL_KEYS,
        "sfreq",
        "nperseg",
        "noverlap",
        (F.call_function("div", F.col("start_sample"), step) + F.col("_w")).alias("window_idx"),
        (F.col("start_sample") + F.col("_w") * step).alias("start_sample"),
        "samples",
    )


def segment_detrend(segments: DataFrame) -> DataFrame:
    """Subtract the mean of each segment."""
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    centred = segments.withColumn("_mean", total / F.size("samples"))
    return centred.withColumn(
        "samples", F.transform("samples", lambda x: x.cast("double") - F.col("_mean"))
    ).drop("_mean")


def window_center_time(segments: DataFrame) -> DataFrame:
    step = F.col("nperseg") - F.col("noverlap")
    return segments.withColumn("time_sec", hop_center(F.col("window_idx"), step, F.size("samples"), F.col("sfreq")))


def periodogram(segments: DataFrame, max_freq: float | None = None, detrend: str | None = "constant") -> DataFrame:
    """One-sided density of each segment: one row per frequency."""
    keys = [c for c in segments.columns if c != "samples"]
    size = F.size("samples").cast("bigint")
    density = spectral_udf(max_freq=max_freq, detrend=detrend)
    spectra = segments.select(*keys, size.alias("_n"), density("samples", "sfreq", size, F.lit(0).cast("bigint")).alias("_psd"))
    return _frequency_rows(spectra, keys, F.size("_psd"), F.col("_n"), max_freq).drop("_w")


def _transform_points(nperseg: Column, sfreq: Column, max_freq: float | None) -> Column:
    if max_freq is None:
        return nperseg
    return F.greatest((nperseg * (F.lit(float(max_freq)) / (sfreq / 2))).cast("bigint"), nperseg)


def _frequency_rows(spectra: DataFrame, keys: list[str], per_window: Column, nperseg: Column, max_freq: float | None):
    points = _transform_points(nperseg, F.col("sfreq"), max_freq)
    # The outer form, because the inner one adds a filter on the array that runs the UDF a second time.
    return spectra.select(
        *keys, points.alias("_points"), per_window.cast("bigint").alias("_bins"), F.posexplode_outer("_psd").alias("_pos", "psd")
    ).where(F.col("_pos").isNotNull()).select(
        *keys,
        F.call_function("div", F.col("_pos"), F.col("_bins")).alias("_w"),
        (F.col("_pos") % F.col("_bins")).alias("freq_idx"),
        ((F.col("_pos") % F.col("_bins")) * F.col("sfreq") / F.col("_points")).alias("freq"),
        "psd",
    )


def spectrogram(laid: DataFrame, detrend: str | None = "constant") -> DataFrame:
    """Density per hopping window and frequency, from blocks in hop_layout."""
    step = F.col("nperseg") - F.col("noverlap")
    window_len = F.least(F.col("nperseg"), F.size("samples").cast("bigint"))
    density = _spectral(laid, detrend=detrend)
    keys = [*SIGNAL_KEYS, "sfreq", "step", "window_len", "start_sample"]
    spectra = _whole_windows(laid).select(
        *SIGNAL_KEYS, "sfreq", step.alias("step"), window_len.alias("window_len"), "start_sample",
        density.alias("_psd"),
    )
    bins = F.call_function("div", F.col("window_len"), F.lit(2)) + 1
    rows = _frequency_rows(spectra, keys, bins, F.col("window_len"), None)
    window = F.call_function("div", F.col("start_sample"), F.col("step")) + F.col("_w")
    return rows.select(
        *SIGNAL_KEYS,
        window.alias("window_idx"),
        hop_center(window, F.col("step"), F.col("window_len"), F.col("sfreq")).alias("time_sec"),
        "freq_idx",
        "freq",
        "psd",
    )


def welch_average(laid: DataFrame, max_freq: float | None = 200.0, detrend: str | None = "constant") -> DataFrame:
    """Mean density of the segments of each time bin, from blocks in welch_layout."""
    density = _spectral(laid, max_freq=max_freq, detrend=detrend, average=True)
    keys = [*SIGNAL_KEYS, "sfreq", "nperseg", "bin_idx", "time_sec"]
    spectra = laid.select(
        *SIGNAL_KEYS, "sfreq", "nperseg",
        F.col("block_idx").alias("bin_idx"),
        bin_center(F.col("start_sample"), F.size("samples"), F.col("sfreq")).alias("time_sec"),
        density.alias("_psd"),
    )
    return _frequency_rows(spectra, keys, F.size("_psd"), F.col("nperseg"), max_freq).drop("nperseg", "sfreq", "_w")


def band_range_join(densities: DataFrame, bands: DataFrame) -> DataFrame:
    """Attach the band a frequency lies in; frequencies outside every band drop out.

    The band table has a handful of rows, so it is broadcast after a check of its size.
    """
    inside = (F.col("freq") >= F.col("fmin")) & (F.col("freq") < F.col("fmax"))
    return densities.join(broadcast_if_small(bands), inside)


def band_mean(densities: DataFrame, keys: list[str], bands: dict = BANDS) -> DataFrame:
    """Mean density per band and spectrum; a band without any frequency is NULL.

    All bands are averaged in one pass with partial sums before the shuffle, then turned to rows.
    """
    def mean_inside(limits):
        fmin, fmax = limits
        return F.avg(F.when((F.col("freq") >= fmin) & (F.col("freq") < fmax), F.col("psd")))

    means = densities.groupBy(*keys).agg(*[mean_inside(limits).alias(f"_{name}") for name, limits in bands.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("band"), F.col(f"_{name}").alias("power")) for name in bands])
    return means.select(*keys, F.explode(rows).alias("b")).select(*keys, "b.band", "b.power")


def _band_rows(summed: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    labels = F.array(*[F.lit(n) for n in names])
    width = F.lit(len(names))
    # The outer form, because the inner one adds a filter on the array that runs the UDF a second time.
    rows = summed.select(*keys, F.posexplode_outer("_power").alias("_pos", "power")).where(F.col("_pos").isNotNull())
    return rows.select(
        *keys,
        F.call_function("div", F.col("_pos"), width).alias("_w"),
        F.element_at(labels, (F.col("_pos") % width + 1).cast("int")).alias("band"),
        "power",
    )


def bandpower_bins(
    laid: DataFrame, bands: dict = BANDS, max_freq: float | None = 200.0, detrend: str | None = "constant", partial: str = "shrink"
) -> DataFrame:
    """Welch band power of every time bin, from blocks in welch_layout.

    A bin shorter than nperseg is one segment of its own length ('shrink') or left out ('drop');
    without more samples than the overlap its power is NULL.
    """
    if partial not in ("shrink", "drop"):
        raise ValueError("partial must be 'shrink' or 'drop'")
    rows = laid if partial == "shrink" else laid.where(F.size("samples") >= F.col("nperseg"))
    power = _spectral(laid, bands=list(bands.values()), max_freq=max_freq, detrend=detrend, average=True)
    summed = rows.select(
        "run_id",
        F.col("block_idx").alias("bin_idx"),
        bin_center(F.col("start_sample"), F.size("samples"), F.col("sfreq")).alias("time_sec"),
        "pair_idx",
        "location",
        power.alias("_power"),
    )
    return _band_rows(summed, ["run_id", "bin_idx", "time_sec", "pair_idx", "location"], list(bands)).drop("_w")


def bandpower_windows(laid: DataFrame, bands: dict = BANDS, detrend: str | None = "constant") -> DataFrame:
    """Band power of every hopping window, from blocks in hop_layout."""
    step = F.col("nperseg") - F.col("noverlap")
    window_len = F.least(F.col("nperseg"), F.size("samples").cast("bigint"))
    power = _spectral(laid, bands=list(bands.values()), detrend=detrend)
    keys = ["run_id", "sfreq", "step", "window_len", "first_window", "pair_idx", "location"]
    summed = _whole_windows(laid).select(
        "run_id", "sfreq", step.alias("step"), window_len.alias("window_len"),
        F.call_function("div", F.col("start_sample"), step).alias("first_window"),
        "pair_idx", "location",
        power.alias("_power"),
    )
    window = F.col("first_window") + F.col("_w")
    return _band_rows(summed, keys, list(bands)).select(
        "run_id",
        window.alias("bin_idx"),
        hop_center(window, F.col("step"), F.col("window_len"), F.col("sfreq")).alias("time_sec"),
        "pair_idx",
        "location",
        "band",
        "power",
    )
