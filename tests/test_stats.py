"""Statistics and quality checks."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leadwave.operators import selection as C
from leadwave.operators import stats as Q
from tests import helpers as H

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
POWER = "run_id string, bin_idx bigint, time_sec double, pair_idx int, band string, power double"


@QUICK
@given(st.lists(st.one_of(st.sampled_from([0.0, 1.0, -2.5]), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_median_is_exact(spark, values):
    frame = spark.createDataFrame([("k", float(v)) for v in values], "key string, v double")
    assert Q.exact_median(frame, ["key"], "v").collect()[0].median == pytest.approx(np.median(values), rel=1e-12, abs=1e-12)


def test_median_of_many_values_with_a_heavy_tie(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.zeros(60_000), rng.standard_normal(90_001)])
    y = rng.standard_normal(120_000)
    frame = spark.createDataFrame([("x", float(v)) for v in x] + [("y", float(v)) for v in y], "key string, v double")
    got = {r.key: r.median for r in Q.exact_median(frame, ["key"], "v").collect()}
    assert got == {"x": np.median(x), "y": pytest.approx(np.median(y), rel=1e-12)}


def test_dropouts_and_flat_segments(spark):
    x = np.random.default_rng(0).standard_normal(1050)
    x[200:300] = 0.0
    x[500:600] *= 0.05
    blocks, rec = H.pair_blocks(spark, x, 130), H.recordings(spark, r=(100.0, 1050))
    stds = Q.window_std(blocks, rec, 1.0).orderBy("window_idx").collect()
    assert len(stds) == 10 and all(r.std == pytest.approx(x[i * 100 : i * 100 + 100].std(), abs=1e-12) for i, r in enumerate(stds))
    found = Q.dropout_detect(blocks, rec, 1.0).orderBy("window_idx").collect()
    assert [r.window_idx for r in found] == [2, 5]
    assert found[0].time_min == pytest.approx(2.5 / 60) and found[0].span_end_min - found[0].span_start_min == pytest.approx(1 / 60)
    assert Q.dropout_counts(Q.dropout_detect(blocks, rec, 1.0)).collect()[0].n_dropouts == 2
    flat = Q.segment_flatness(blocks, rec, 1.0).orderBy("segment_idx").collect()
    assert len(flat) == 10 and [r.zero_channels for r in flat] == [0, 0, 1] + [0] * 7


def test_a_nan_window_leaves_a_channel_without_dropouts(spark):
    x = np.random.default_rng(0).standard_normal(500)
    x[100:200] = 0.0
    x[320] = np.nan
    blocks, rec = H.pair_blocks(spark, x, 130), H.recordings(spark, r=(100.0, 500))
    assert Q.dropout_detect(blocks, rec, 1.0).count() == 0
    frame = spark.createDataFrame([("k", 1.0), ("k", float("nan")), ("l", 2.0)], "key string, v double")
    got = {r.key: r.median for r in Q.exact_median(frame, ["key"], "v").collect()}
    assert np.isnan(got["k"]) and got["l"] == 2.0


def test_minimum_keeps_nan_like_the_mean(spark):
    rows = Q.signal_stats(H.pair_blocks(spark, [1.0, float("nan"), -2.0], 2), ["run_id"]).collect()[0]
    assert all(np.isnan(v) for v in (rows.min, rows.max, rows.mean, rows.std, rows.range))


def test_layout_of_traces_and_ratio(spark):
    rng = np.random.default_rng(3)
    channels = [rng.standard_normal(50).astype(np.float32) for _ in range(3)]
    raw = H.blocks(spark, {"r": channels}, 20)
    joined = np.concatenate(channels).astype(float)
    rows = Q.trace_layout(raw).orderBy("channel_pos").collect()
    assert [r.offset for r in rows] == pytest.approx([i * 4 * joined.std() for i in range(3)])
    pair = channels[0].astype(float) - channels[1]
    ratio = Q.raw_vs_bipolar_ratio(raw, H.pair_blocks(spark, pair, 20)).collect()[0]
    assert ratio.std_ratio == pytest.approx(pair.std() / joined.std())
    assert ratio.range_ratio == pytest.approx(np.ptp(pair) / np.ptp(joined))
    assert ratio.axis_low == pytest.approx(min(pair.min(), *(c.min() + i * 4 * joined.std() for i, c in enumerate(channels))))


def power(spark, values):
    return spark.createDataFrame([("r", i, float(i), 0, "alpha", v) for i, v in enumerate(values)], POWER)


@pytest.mark.parametrize("values, flags", [
    ([1.0, 2.0], (False, False, False)),
    ([0.0, -1e-9], (False, False, True)),
    ([0.0, None], (True, False, False)),
    ([0.0, float("nan")], (True, False, False)),
    ([0.0, float("-inf")], (False, True, False)),
])
def test_quality_flags(spark, values, flags):
    row = Q.quality_flags(power(spark, values)).collect()[0]
    assert (row.has_nan, row.has_inf, row.all_zero) == flags


def test_tail_starts_after_a_third(spark):
    assert sorted(r.bin_idx for r in Q.tail_windows(power(spark, [0.0] * 8)).collect()) == [2, 3, 4, 5, 6, 7]


def test_rate_from_first_windows(spark):
    frame = spark.createDataFrame([("a", 0, 0.5, 0, "x", 1.0), ("a", 1, 1.0, 0, "x", 1.0), ("b", 0, 30.0, 0, "x", 1.0)], POWER)
    assert {r.run_id: r.rate for r in Q.output_rate(frame, 60.0).collect()} == {"a": 2.0, "b": 1 / 60}
    assert {r.run_id: r.rate for r in Q.output_rate(frame).collect()}["b"] is None


def test_segments_are_clamped_to_short_recordings(spark):
    rec = H.recordings(spark, long=(10.0, 1000), short=(10.0, 30))
    bounds = {s: {r.run_id: (r.seg_start, r.seg_end) for r in C.segment_bounds(rec, 0.5, s).collect()} for s in ("start", "middle", "end")}
    assert {s: b["long"] for s, b in bounds.items()} == {"start": (0, 300), "middle": (350, 650), "end": (700, 1000)}
    assert all(b["short"] == (0, 30) for b in bounds.values())
    with pytest.raises(ValueError):
        C.segment_bounds(rec, 0.5, "first")
