"""The short-time Fourier step: an Arrow UDF that works on whole batches of sample arrays."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The UDF travels with its helpers, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Doubles held at once by one transform, so that memory does not follow the batch size.
CHUNK_VALUES = 250_000


def transform_length(nperseg: int, sfreq: float, max_freq: float) -> int:
    """Points of the transform: zero-padded only where max_freq lies above the Nyquist frequency."""
    return max(int(nperseg * (max_freq / (sfreq / 2))), nperseg)


def periodic_hann(n: int) -> np.ndarray:
    """Periodic Hann window; a single sample keeps its weight."""
    return np.ones(1) if n == 1 else 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)


def _band_bins(bands, sfreq: float, nfft: int) -> list[slice]:
    """Frequency bins k * sfreq / nfft inside each band, as ranges of k; empty where a band has none."""
    freqs = np.arange(nfft // 2 + 1) * sfreq / nfft
    return [slice(*np.searchsorted(freqs, limits, side="left")) for limits in bands]


def _density_weights(length: int, sfreq: float, nfft: int, taper: np.ndarray) -> np.ndarray:
    """Factor from squared magnitude to one-sided density per frequency bin."""
    sides = np.full(nfft // 2 + 1, 2.0)
    sides[0] = 1.0
    if nfft % 2 == 0:
        sides[-1] = 1.0
    return sides / (sfreq * np.sum(taper**2))


def _summarise(fetch, n_rows, size, sfreq, nperseg, noverlap, nfft, bands, detrend, average):
    """Densities, or their means per band, of n_rows rows of equal size; one flat array per row.

    fetch(lo, hi) gives the rows as a matrix. They are transformed in groups of bounded size, in work
    arrays that are allocated once.
    """
    length = min(nperseg, size)
    step = length - noverlap
    if length == 0 or step <= 0:
        return np.empty((n_rows, 0)) if bands is None else np.full((n_rows, len(bands)), np.nan)
    taper = periodic_hann(length)
    ranges = [slice(0, nfft // 2 + 1)] if bands is None else _band_bins(bands, sfreq, nfft)
    used = [r for r in ranges if r.stop > r.start]
    bins = slice(min(r.start for r in used), max(r.stop for r in used)) if used else slice(0, 0)
    weights = _density_weights(length, sfreq, nfft, taper)[bins]
    n_windows = (size - noverlap) // step
    group = min(n_rows, max(1, CHUNK_VALUES // (n_windows * nfft)))
    tapered = np.empty((group, n_windows, length))
    spectrum = np.empty((group, n_windows, nfft // 2 + 1), dtype=np.complex128)
    parts = []
    for lo in range(0, n_rows, group):
        x = fetch(lo, min(lo + group, n_rows))
        windows = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, ::step]
        work, waves = tapered[: len(x)], spectrum[: len(x)]
        np.subtract(windows, windows.mean(axis=-1, keepdims=True) if detrend == "constant" else 0.0, out=work)
        work *= taper
        np.fft.rfft(work, n=nfft, axis=-1, out=waves)
        density = waves.real[..., bins] ** 2 + waves.imag[..., bins] ** 2
        if average:
            density = density.mean(axis=1, keepdims=True)
        density *= weights
        if bands is not None:
            missing = np.full(density.shape[:-1], np.nan)
            means = [
                density[..., r.start - bins.start : r.stop - bins.start].mean(axis=-1) if r.stop > r.start else missing
                for r in ranges
            ]
            density = np.stack(means, axis=-1)
        parts.append(density.reshape(len(x), -1))
    return np.concatenate(parts)


def _undefined(bands, sfreq, nperseg, noverlap, nfft, n_samples):
    """Bands that have no value at all (no frequency inside, or no window): NULL, unlike a NaN signal."""
    if min(nperseg, n_samples) <= noverlap:
        return np.ones(len(bands), dtype=bool)
    return np.array([r.stop <= r.start for r in _band_bins(bands, sfreq, nfft)])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, offsets and sizes of a list column."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return values, offsets, np.diff(offsets)


def _stacked(lists, rows, size) -> np.ndarray:
    values, offsets, _ = lists
    return np.stack([values[offsets[r] : offsets[r] + size] for r in rows]).astype(np.float64, copy=False)


def spectral_udf(
    bands=None, max_freq: float | None = None, detrend: str | None = "constant", average: bool = False, paired: bool = False
):
    """UDF (samples, sfreq, nperseg, noverlap) -> ARRAY<DOUBLE>.

    Without bands: densities of every window, one after the other. With bands: one mean per band and
    window. `average` first averages the windows of the row. A row shorter than nperseg is one
    window of its own length; windows need more than noverlap samples. A paired UDF takes a second
    array after the first, of equal size, and subtracts it.
    """
    if detrend not in ("constant", None):
        raise ValueError("detrend must be 'constant' or None")
    limits = None if bands is None else [tuple(map(float, b)) for b in bands]

    def spectra(samples, other, sfreq, nperseg, noverlap):
        lists = _lists(samples)
        others = None if other is None else _lists(other)
        rates, lengths, overlaps = (a.to_numpy(zero_copy_only=False) for a in (sfreq, nperseg, noverlap))
        settings = np.stack([lists[2], rates, lengths, overlaps], axis=1).astype(np.float64)
        kinds, member = np.unique(settings, axis=0, return_inverse=True)
        pieces: list = [None] * len(settings)
        masks: list = [None] * len(settings)
        for kind, (size, rate, length, overlap) in enumerate(kinds):
            rows = np.flatnonzero(member.reshape(-1) == kind)
            size, length, overlap = int(size), int(length), int(overlap)
            nfft = min(length, size) if max_freq is None else transform_length(length, rate, max_freq)
            mask = None if limits is None else _undefined(limits, rate, length, overlap, nfft, size)

            def fetch(lo, hi, rows=rows, size=size):
                x = _stacked(lists, rows[lo:hi], size)
                return x if others is None else x - _stacked(others, rows[lo:hi], size)

            result = _summarise(fetch, len(rows), size, rate, length, overlap, nfft, limits, detrend, average)
            empty = np.zeros(result.shape[1], bool) if mask is None else np.tile(mask, result.shape[1] // len(mask))
            for r, piece in zip(rows, result):
                pieces[r], masks[r] = piece, empty
        if not pieces:
            return pa.array([], pa.list_(pa.float64()))
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
        flat = pa.array(np.concatenate(pieces), mask=np.concatenate(masks))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)

    if paired:

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def spectral_pair(samples: pa.Array, other: pa.Array, sfreq: pa.Array, nperseg: pa.Array, noverlap: pa.Array) -> pa.Array:
            return spectra(samples, other, sfreq, nperseg, noverlap)

        return spectral_pair

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def spectral(samples: pa.Array, sfreq: pa.Array, nperseg: pa.Array, noverlap: pa.Array) -> pa.Array:
        return spectra(samples, None, sfreq, nperseg, noverlap)

    return spectral
