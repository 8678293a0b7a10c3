"""Small recordings made by hand and plain NumPy versions of what the jobs compute."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from leadwave.schema import BANDS, SERIES_NAME

SIGNAL_TYPE = "run_id string, series_name string, channel_pos int, block_idx bigint, start_sample bigint, samples array<float>"


def blocks(spark, runs: dict, block_len: int):
    """runs: run_id -> list of channels, each a sequence of samples."""
    rows = []
    for run, channels in runs.items():
        for channel, x in enumerate(channels):
            for b in range(0, len(x), block_len):
                rows.append((run, SERIES_NAME, channel, b // block_len, b, [float(v) for v in x[b : b + block_len]]))
    return spark.createDataFrame(rows, SIGNAL_TYPE)


def pair_blocks(spark, x, block_len: int, run: str = "r"):
    """One pair's signal as blocks of doubles."""
    rows = [(run, SERIES_NAME, 0, "A1-A2", b // block_len, b, [float(v) for v in x[b : b + block_len]]) for b in range(0, len(x), block_len)]
    return spark.createDataFrame(
        rows, "run_id string, series_name string, pair_idx int, location string, block_idx bigint, start_sample bigint, samples array<double>"
    )


def recordings(spark, **rates):
    """run_id = (sfreq, n_samples)"""
    rows = [(run, SERIES_NAME, float(fs), int(n), 2, "described", run) for run, (fs, n) in rates.items()]
    frame = spark.createDataFrame(
        rows, "run_id string, series_name string, sfreq double, n_samples bigint, n_channels int, session_description string, identifier string"
    )
    nothing = F.lit(None).cast("string")
    return frame.withColumns({c: nothing for c in ("experimenter", "lab", "institution", "subject")} | {
        c: F.lit(None).cast("timestamp") for c in ("session_start_time", "timestamps_reference_time")})


def electrodes(spark, runs: dict, **columns):
    """runs: run_id -> labels; electrode ids start at 100."""
    rows = [(run, 100 + i, label) for run, labels in runs.items() for i, label in enumerate(labels)]
    frame = spark.createDataFrame(rows, "run_id string, electrode_id int, location string")
    return frame.withColumns({name: F.lit(value) for name, value in columns.items()})


def channel_map(electrode_table):
    return electrode_table.select("run_id", (F.col("electrode_id") - 100).alias("channel_pos"), "electrode_id")


def density(x, fs, nfft=None, detrend=True):
    """One-sided Hann density by the definition, without a fast transform."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    nfft = nfft or n
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    x = (x - x.mean() if detrend else x) * w
    k = np.arange(nfft // 2 + 1)
    phase = 2 * np.pi * np.outer(k, np.arange(n)) / nfft
    p = ((x * np.cos(phase)).sum(1) ** 2 + (x * np.sin(phase)).sum(1) ** 2) / (fs * (w**2).sum())
    single = (k == 0) | ((nfft % 2 == 0) & (k == nfft // 2))
    return k * fs / nfft, np.where(single, p, 2 * p)


def band_means(freqs, p, bands=BANDS):
    out = {}
    for name, (lo, hi) in bands.items():
        inside = (freqs >= lo) & (freqs < hi)
        out[name] = p[inside].mean() if inside.any() else None
    return out


def welch(x, fs, nperseg, noverlap, max_freq=None):
    n = min(nperseg, len(x))
    if n <= noverlap:
        return {name: None for name in BANDS}
    nfft = n if max_freq is None else max(int(nperseg * (max_freq / (fs / 2))), nperseg)
    parts = [density(x[s : s + n], fs, nfft) for s in range(0, len(x) - n + 1, n - noverlap)]
    return band_means(parts[0][0], np.mean([p for _, p in parts], axis=0))


def windows(x, fs, nperseg, noverlap):
    """[(centre, band means)] of the hopping windows."""
    n = min(nperseg, len(x))
    step = n - noverlap
    return [((s + n / 2) / fs, band_means(*density(x[s : s + n], fs))) for s in range(0, len(x) - n + 1, step)]
