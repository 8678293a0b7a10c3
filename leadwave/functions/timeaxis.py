"""Time axis expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_minutes(sample_idx: Column, sfreq: Column) -> Column:
    """Absolute time of a sample in minutes."""
    return sample_idx / sfreq / F.lit(60.0)


def hop_center(window_idx: Column, step: Column, length: Column, sfreq: Column) -> Column:
    """Centre of a hopping window in seconds."""
    return (window_idx * step + length / F.lit(2.0)) / sfreq


def bin_center(start_sample: Column, length: Column, sfreq: Column) -> Column:
    """Midpoint of a time bin in seconds."""
    return (start_sample + length / F.lit(2.0)) / sfreq


def axis_from_rate(bin_idx: Column, rate: Column) -> Column:
    """Time axis rebuilt from a stored rate, in seconds. It starts at 0, not at a window centre."""
    return bin_idx / rate


def whole_samples(seconds: float | Column, sfreq: Column) -> Column:
    """Number of samples in a duration, truncated."""
    return (F.lit(seconds) * sfreq).cast("bigint")


def to_microvolt(volt: Column) -> Column:
    return volt * F.lit(1e6)
