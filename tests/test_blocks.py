"""Block layout: building, cutting, slicing, pairing."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadwave.operators import blocks as B
from leadwave.operators import pairs as P
from leadwave.operators.rereference import bipolar_subtract
from leadwave.schema import SERIES_NAME
from tests import helpers as H

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def long(frame, key="channel_pos"):
    return {(r.run_id, r[key], r.sample_idx): r.value for r in B.sample_rows(frame).collect()}


@QUICK
@given(n=st.integers(1, 60), stored=st.integers(1, 25), length=st.integers(1, 25), halo=st.integers(0, 30))
def test_recut_gives_every_bin_with_its_halo(spark, n, stored, length, halo):
    x = np.arange(n, dtype=float)
    cut = B.recut(H.blocks(spark, {"r": [x]}, stored), ["run_id", "channel_pos"], length, halo)
    got = {r.block_idx: (r.start_sample, r.samples) for r in cut.collect()}
    assert set(got) == set(range(-(-n // length)))
    for b, (start, samples) in got.items():
        assert start == b * length
        assert samples == list(x[start : start + length + halo])


@QUICK
@given(n=st.integers(1, 50), stored=st.integers(1, 20), lo=st.integers(0, 55), size=st.integers(0, 30), known=st.booleans())
def test_slice_keeps_exactly_the_range(spark, n, stored, lo, size, known):
    frame = H.blocks(spark, {"r": [np.arange(n)]}, stored)
    got = long(B.slice_samples(frame, lo, lo + size, stored if known else None))
    assert sorted(i for _, _, i in got) == list(range(min(lo, n), min(lo + size, n)))
    assert all(i == v for (_, _, i), v in got.items())


def test_frames_and_samples_give_the_same_blocks(spark):
    values = np.random.default_rng(0).standard_normal((23, 3)).astype(np.float32)
    frames = spark.createDataFrame([("r", SERIES_NAME, i, [float(v) for v in row]) for i, row in enumerate(values)],
                                   "run_id string, series_name string, sample_idx bigint, frame array<float>")
    samples = spark.createDataFrame([("r", SERIES_NAME, c, i, float(values[i, c])) for i in range(23) for c in range(3)],
                                    "run_id string, series_name string, channel_pos int, sample_idx bigint, value double")
    expected = {("r", c, i): values[i, c] for i in range(23) for c in range(3)}
    for frame in (B.blocks_from_frames(frames, 7), B.blocks_from_samples(samples, 7)):
        assert frame.count() == 12
        assert long(frame) == expected
    measured = B.measure_recordings(B.blocks_from_frames(frames, 7)).collect()[0]
    assert (measured.n_samples, measured.n_channels) == (23, 3)


def brute_pairs(channels, labels):
    pairs = [(i, labels.index(f"{l[0]}{int(l[1:]) + 1}")) for i, l in enumerate(labels) if f"{l[0]}{int(l[1:]) + 1}" in labels]
    pairs.sort(key=lambda p: (labels[p[0]][0], int(labels[p[0]][1:])))
    return {(k, t): channels[a][t] - channels[c][t] for k, (a, c) in enumerate(pairs) for t in range(min(len(channels[a]), len(channels[c])))}


@pytest.mark.parametrize("stored", [1, 4, 100])
def test_subtraction_across_groups_and_uneven_channels(spark, stored):
    """A shaft longer than one group of contacts; channels of different length; a channel without pair."""
    labels = [f"A{i}" for i in (30, 31, 32, 33, 34, 64, 63, 65, 70)]
    rng = np.random.default_rng(1)
    channels = [rng.integers(-9, 9, size=n).astype(float) for n in (10, 9, 10, 3, 10, 8, 8, 4, 5)]
    electrodes = H.electrodes(spark, {"r": labels})
    signals = H.blocks(spark, {"r": channels}, stored)
    got = bipolar_subtract(signals, H.channel_map(electrodes), P.bipolar_pairs(electrodes))
    assert {(p, t): v for (_, p, t), v in long(got, "pair_idx").items()} == brute_pairs(channels, labels)


def test_subtraction_with_another_layout_is_the_same(spark):
    labels = ["A1", "A2", "A3"]
    channels = [np.arange(50.0) * k for k in (1, 3, 7)]
    electrodes = H.electrodes(spark, {"r": labels})
    layout = spark.createDataFrame([("r", 50, 8, 0)], "run_id string, n_samples bigint, block_len bigint, halo bigint")
    got = bipolar_subtract(H.blocks(spark, {"r": channels}, 11), H.channel_map(electrodes), P.bipolar_pairs(electrodes), layout)
    assert got.count() == 2 * 7
    assert {(p, t): v for (_, p, t), v in long(got, "pair_idx").items()} == brute_pairs(channels, labels)


def test_common_signal_cancels(spark):
    x = np.random.default_rng(2).standard_normal(40).astype(np.float32)
    electrodes = H.electrodes(spark, {"r": ["A1", "A2", "A3"]})
    got = bipolar_subtract(H.blocks(spark, {"r": [x, x, x]}, 16), H.channel_map(electrodes), P.bipolar_pairs(electrodes))
    assert set(long(got, "pair_idx").values()) == {0.0}


def test_integers_do_not_wrap_around(spark):
    rows = [("r", SERIES_NAME, c, 0, 0, [v]) for c, v in enumerate((-30000, 30000))]
    signals = spark.createDataFrame(rows, "run_id string, series_name string, channel_pos int, block_idx bigint, start_sample bigint, samples array<smallint>")
    electrodes = H.electrodes(spark, {"r": ["A1", "A2"]})
    got = bipolar_subtract(signals, H.channel_map(electrodes), P.bipolar_pairs(electrodes)).select(F.col("samples")[0]).collect()
    assert got[0][0] == -60000.0
