"""Densities and band power against the definition, with plain NumPy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadwave.operators import spectrum as W
from leadwave.plans.bandpower import bandpower_stft, bandpower_welch, bandpower_welch_bin
from leadwave.schema import BANDS, bands_frame
from tests import helpers as H

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
FS = 400.0


def by_bin(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r.bin_idx, r.time_sec), {})[r.band] = r.power
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for band, value in expected.items():
        assert got[band] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-18)), band


def noise(n, seed=0):
    return np.random.default_rng(seed).standard_normal(n)


@QUICK
@given(n=st.integers(30, 400), stored=st.integers(20, 200), nperseg=st.sampled_from([20, 33, 64]), overlap=st.sampled_from([0.0, 0.5, 0.75]),
       max_freq=st.sampled_from([None, 150.0, 333.0]), bin_samples=st.sampled_from([40, 100]))
def test_welch_bins(spark, n, stored, nperseg, overlap, max_freq, bin_samples):
    x = noise(n, n)
    got = by_bin(bandpower_welch(H.pair_blocks(spark, x, stored), H.recordings(spark, r=(FS, n)), nperseg=nperseg, overlap=overlap,
                                 bin_sec=bin_samples / FS, max_freq=max_freq))
    starts = range(0, n, bin_samples)
    assert sorted(b for b, _ in got) == list(range(len(starts)))
    for (b, t), values in got.items():
        part = x[b * bin_samples : (b + 1) * bin_samples]
        assert t == pytest.approx((b * bin_samples + len(part) / 2) / FS)
        same(values, H.welch(part, FS, nperseg, int(nperseg * overlap), max_freq))


@QUICK
@given(n=st.integers(10, 300), stored=st.integers(7, 200), nperseg=st.sampled_from([20, 33, 64]), overlap=st.sampled_from([0.0, 0.5, 0.8]),
       target=st.sampled_from([1, 50, 60_000]))
def test_hopping_windows_across_block_edges(spark, n, stored, nperseg, overlap, target):
    x, before = noise(n, n), W.HOP_BLOCK_SAMPLES
    noverlap = int(nperseg * overlap)
    W.HOP_BLOCK_SAMPLES = target
    try:
        power = bandpower_stft(H.pair_blocks(spark, x, stored), H.recordings(spark, r=(FS, n)), nperseg=nperseg, overlap=overlap)
        if n <= noverlap:
            with pytest.raises(Exception, match="run r: recording too short"):
                power.collect()
            return
        got = by_bin(power)
    finally:
        W.HOP_BLOCK_SAMPLES = before
    expected = H.windows(x, FS, nperseg, noverlap)
    assert len(got) == len(expected)
    for (b, t), values in got.items():
        centre, means = expected[b]
        assert t == pytest.approx(centre)
        same(values, means)


def test_full_spectra_and_their_band_means(spark):
    x = noise(230)
    recordings = H.recordings(spark, r=(FS, 230))
    laid = W.relayout(H.pair_blocks(spark, x, 64), W.hop_layout(recordings, nperseg=50, overlap=0.5))
    rows = W.spectrogram(laid)
    for r in rows.collect():
        freqs, p = H.density(x[r.window_idx * 25 : r.window_idx * 25 + 50], FS)
        assert (r.freq, r.psd) == (pytest.approx(freqs[r.freq_idx]), pytest.approx(p[r.freq_idx], rel=1e-9, abs=1e-15))
    assert rows.count() == 8 * 26
    means = {(r.window_idx, r.band): r.power for r in W.band_mean(rows, ["window_idx"]).collect()}
    direct = {(r.bin_idx, r.band): r.power for r in W.bandpower_windows(laid).collect()}
    assert means.keys() == direct.keys() and all(v == (None if direct[k] is None else pytest.approx(direct[k])) for k, v in means.items())
    inside = W.band_range_join(rows, bands_frame(spark)).where("window_idx = 0").groupBy("band").count().collect()
    assert {r["band"]: r["count"] for r in inside} == {"alpha": 1, "beta": 2, "gamma": 5, "high_gamma": 13}


def test_segments_and_their_periodograms(spark):
    x = noise(95)
    laid = W.relayout(H.pair_blocks(spark, x, 30), W.hop_layout(H.recordings(spark, r=(FS, 95)), nperseg=40, overlap=0.5))
    segments = W.hop_segments(laid)
    centred = {r.window_idx: (r.time_sec, r.samples) for r in W.window_center_time(W.segment_detrend(segments)).collect()}
    assert sorted(centred) == [0, 1, 2]
    for w, (t, samples) in centred.items():
        part = x[w * 20 : w * 20 + 40]
        assert t == pytest.approx((w * 20 + 20) / FS) and np.allclose(samples, part - part.mean())
    for r in W.periodogram(segments).collect():
        assert r.psd == pytest.approx(H.density(x[r.window_idx * 20 : r.window_idx * 20 + 40], FS)[1][r.freq_idx], rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("hz, band", [(2, "delta"), (6, "theta"), (10, "alpha"), (20, "beta"), (40, "gamma"), (100, "high_gamma")])
def test_a_sine_lands_in_its_band(spark, hz, band):
    x = np.sin(2 * np.pi * hz * np.arange(800) / FS)
    got = by_bin(bandpower_welch(H.pair_blocks(spark, x, 300), H.recordings(spark, r=(FS, 800)), nperseg=400, bin_sec=2.0, max_freq=None))
    means = got[(0, 1.0)]
    total = {name: value * (BANDS[name][1] - BANDS[name][0]) for name, value in means.items()}
    assert total[band] > 0.99 * sum(total.values())


def test_sum_of_the_density_is_the_tapered_variance(spark):
    x = noise(128)
    segments = H.pair_blocks(spark, x, 128).select("run_id", "pair_idx", F.lit(FS).alias("sfreq"), F.lit(0).alias("window_idx"), "samples")
    total = W.periodogram(segments).agg(F.sum("psd")).collect()[0][0] * FS / 128
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(128) / 128)
    assert total == pytest.approx((((x - x.mean()) * w) ** 2).sum() / (w**2).sum(), rel=1e-9)


def test_constant_signal_has_no_power_unless_kept(spark):
    blocks, rec = H.pair_blocks(spark, np.full(100, 3.5), 40), H.recordings(spark, r=(FS, 100))
    flat = bandpower_welch(blocks, rec, nperseg=100, bin_sec=0.25, max_freq=None).collect()
    assert all(r.power is None or abs(r.power) < 1e-25 for r in flat)
    kept = bandpower_welch(blocks, rec, nperseg=100, bin_sec=0.25, max_freq=None, detrend=None, bands={"low": (0.0, 5.0)}).collect()
    assert kept[0].power > 0.01


def test_partial_bins(spark):
    blocks, rec = H.pair_blocks(spark, noise(250), 100), H.recordings(spark, r=(FS, 250))
    shrink = by_bin(bandpower_welch(blocks, rec, nperseg=100, overlap=0.5, bin_sec=0.5))
    assert sorted(b for b, _ in shrink) == [0, 1] and set(shrink[(1, 225 / FS)].values()) == {None}
    drop = by_bin(bandpower_welch(blocks, rec, nperseg=100, overlap=0.5, bin_sec=0.5, partial="drop"))
    assert sorted(b for b, _ in drop) == [0]
    one = by_bin(bandpower_welch_bin(blocks, rec, 0, nperseg=100, overlap=0.5, bin_sec=0.5))
    same(one[(0, 0.25)], shrink[(0, 0.25)])


def test_rates_differ_between_runs(spark):
    x = noise(300)
    blocks = H.pair_blocks(spark, x, 64, "a").unionByName(H.pair_blocks(spark, x, 64, "b"))
    got = bandpower_stft(blocks, H.recordings(spark, a=(400, 300), b=(250, 300)), window_sec=0.2, overlap_sec=0.1)
    for run, fs in (("a", 400.0), ("b", 250.0)):
        rows = by_bin(got.where(F.col("run_id") == run))
        expected = H.windows(x, fs, int(0.2 * fs), int(0.1 * fs))
        assert len(rows) == len(expected)
        for (b, t), values in rows.items():
            assert t == pytest.approx(expected[b][0])
            same(values, expected[b][1])


def test_bad_samples_stay_visible(spark):
    x = noise(100)
    x[3] = np.nan
    got = bandpower_welch(H.pair_blocks(spark, x, 50), H.recordings(spark, r=(FS, 100)), nperseg=50, bin_sec=0.125)
    powers = {(r.bin_idx, r.band): r.power for r in got.collect()}
    assert np.isnan(powers[(0, "gamma")]) and powers[(0, "delta")] is None and powers[(1, "gamma")] > 0


def test_settings_are_checked(spark):
    blocks, rec = H.pair_blocks(spark, noise(20), 20), H.recordings(spark, r=(FS, 20))
    with pytest.raises(ValueError):
        bandpower_welch(blocks, rec, partial="keep")
    with pytest.raises(ValueError):
        bandpower_welch(blocks, rec, detrend="linear")


@pytest.mark.parametrize("work", ["stft", "welch"])
def test_an_overlap_of_a_whole_segment_is_an_error(spark, work):
    blocks, recordings = H.pair_blocks(spark, noise(300), 64), H.recordings(spark, r=(FS, 300))
    power = (
        bandpower_stft(blocks, recordings, window_sec=0.2, overlap_sec=0.2) if work == "stft" else bandpower_welch(blocks, recordings, nperseg=50, overlap=1.0, bin_sec=0.5)
    )
    with pytest.raises(Exception, match="run r: overlap not below segment length"):
        power.collect()
