"""Band power over time from signal blocks of pairs or straight from raw channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwave.operators.blocks import series_key, slice_samples
from leadwave.operators.rereference import pair_blocks
from leadwave.operators.spectrum import bandpower_bins, bandpower_windows, hop_layout, relayout, welch_layout
from leadwave.schema import BANDS
from leadwave.session import join_metadata, materialise


def bandpower_welch(
    blocks: DataFrame, recordings: DataFrame, bands: dict = BANDS, nperseg: int | None = 2000, overlap: float = 0.5,
    bin_sec: float = 60.0, max_freq: float | None = 200.0, detrend: str | None = "constant", partial: str = "shrink",
) -> DataFrame:
    """Band power per time bin of pair blocks, all runs in one job."""
    laid = relayout(blocks, welch_layout(recordings, nperseg, overlap, bin_sec))
    return bandpower_bins(laid, bands, max_freq, detrend, partial)


def bandpower_welch_bin(
    blocks: DataFrame, recordings: DataFrame, bin_idx: int, bands: dict = BANDS, nperseg: int | None = None, overlap: float = 0.5,
    bin_sec: float = 10.0, max_freq: float | None = 200.0, detrend: str | None = "constant", partial: str = "shrink",
) -> DataFrame:
    """Band power of one time bin; other blocks are left out before they are moved."""
    layout = welch_layout(recordings, nperseg, overlap, bin_sec)
    bounds = layout.select("run_id", (F.col("block_len") * bin_idx).alias("_lo"), (F.col("block_len") * (bin_idx + 1)).alias("_hi"))
    near = join_metadata(blocks, bounds, ["run_id"]).where(
        (F.col("start_sample") < F.col("_hi")) & (F.col("start_sample") + F.size("samples") > F.col("_lo"))
    ).drop("_lo", "_hi")
    laid = relayout(near, layout).where(F.col("block_idx") == bin_idx)
    return bandpower_bins(laid, bands, max_freq, detrend, partial)


def bipolar_welch_bin(
    signals: DataFrame, channel_map: DataFrame, pairs: DataFrame, recordings: DataFrame, bin_idx: int, bands: dict = BANDS,
    nperseg: int | None = None, overlap: float = 0.5, bin_sec: float = 10.0, max_freq: float | None = 200.0,
    detrend: str | None = "constant", partial: str = "shrink", block_len: int | None = None,
) -> DataFrame:
    """Band power of one time bin straight from raw channels: they are cut to the bin's samples before any of them is moved or subtracted.

    `block_len`, the length of the stored blocks, gives the scan a range of blocks too: from the least to the greatest sample of
    that bin over all recordings (two numbers, from the layout alone).
    """
    layout = materialise(welch_layout(recordings, nperseg, overlap, bin_sec))
    on = series_key(signals, layout)
    low, high = F.col("block_len") * bin_idx, F.col("block_len") * (bin_idx + 1)
    if block_len is not None:
        least, most = layout.agg(F.min(low), F.max(high)).first()
        if least is not None:
            signals = signals.where(F.col("block_idx").between(least // block_len, (most - 1) // block_len))
    bounded = join_metadata(signals, layout.select(*on, low.alias("_lo"), high.alias("_hi")), on)
    inside = slice_samples(bounded, F.col("_lo"), F.col("_hi")).drop("_lo", "_hi")
    return bipolar_bandpower(inside, channel_map, pairs, layout, "welch", bands, max_freq, detrend, partial)


def bandpower_stft(
    blocks: DataFrame, recordings: DataFrame, bands: dict = BANDS, nperseg: int = 500, overlap: float = 0.5,
    window_sec: float | None = None, overlap_sec: float | None = None, detrend: str | None = "constant",
) -> DataFrame:
    """Band power per hopping window of pair blocks, all runs in one job."""
    laid = relayout(blocks, hop_layout(recordings, nperseg, overlap, window_sec, overlap_sec))
    return bandpower_windows(laid, bands, detrend)


def bipolar_bandpower(
    signals: DataFrame, channel_map: DataFrame, pairs: DataFrame, layout: DataFrame, method: str, bands: dict = BANDS,
    max_freq: float | None = 200.0, detrend: str | None = "constant", partial: str = "shrink", aligned: bool = False,
) -> DataFrame:
    """Raw channels to band power with a single shuffle of the signal: cutting to bins and bringing
    neighbouring contacts together happen in one exchange, and the difference is taken in the spectral
    step, which reads both arrays. `aligned` says that stored blocks are the bins already."""
    laid = pair_blocks(signals, channel_map, pairs, layout, aligned)
    if method == "welch":
        return bandpower_bins(laid, bands, max_freq, detrend, partial)
    return bandpower_windows(laid, bands, detrend)
