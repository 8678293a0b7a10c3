"""Samples that are absent, stored twice or misaligned, and runs of several series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SIGNAL_TYPE, blocks, channel_map, electrodes, recordings, welch
from leadwave.operators import blocks as B
from leadwave.operators import stats as Q
from leadwave.operators.pairs import bipolar_pairs
from leadwave.operators.rereference import bipolar_subtract
from leadwave.plans.bandpower import bipolar_welch_bin
from leadwave.plans.pipeline import process
from leadwave.schema import SERIES_NAME

RANDOM = np.random.default_rng(3)
X = RANDOM.normal(size=(3, 400)).astype(np.float32)
SETTINGS = {"nperseg": 40, "overlap": 0.5, "bin_sec": 1.0, "max_freq": 50.0}


def stored(spark):
    """One run of three channels at 100 Hz in blocks of 50."""
    elec = electrodes(spark, {"r": ["A1", "A2", "A3"]}, group="g", group_name="sEEG")
    return blocks(spark, {"r": list(X)}, 50), recordings(spark, r=(100.0, 400)), elec, channel_map(elec)


def test_manifest_names_first_bad_sample(spark):
    whole = stored(spark)[0]
    assert B.block_gaps(B.block_manifest(whole)).isEmpty()
    extra = spark.createDataFrame([("r", SERIES_NAME, 1, 1, 60, [0.0] * 10), ("r", SERIES_NAME, 2, 0, 0, [])], SIGNAL_TYPE)
    broken = whole.where("not (channel_pos = 0 and block_idx in (2, 3))").unionByName(extra)
    found = {(r.channel_pos, r.first_bad_sample, r.problem) for r in B.block_gaps(B.block_manifest(broken)).collect()}
    assert found == {(0, 100, "missing"), (1, 60, "repeated")}


def test_a_run_with_a_hole_is_failed_by_its_manifest(spark):
    signals, *rest = stored(spark)
    holed = signals.where("not (channel_pos = 1 and block_idx = 3)")
    results = process(holed, *rest, "chunked", manifest=B.block_manifest(holed), **SETTINGS)
    assert [tuple(r) for r in results["status"].select("run_id", "status", "reason").collect()] == [("r", "failed", "samples missing from 150 on in channel 1")]
    assert results["band_power"].isEmpty()


@pytest.mark.parametrize("gone", [3, 0, 2])
def test_without_manifest_only_bins_with_absent_samples_are_undefined(spark, gone):
    """Blocks 2 and 3 make bin 1, block 0 starts bin 0: no other bin moves, and none is joined over the hole."""
    signals, *rest = stored(spark)
    holed = signals.where(f"not (channel_pos = 1 and block_idx = {gone})")
    power = {(r.pair_idx, r.bin_idx, r.band): (r.time_sec, r.power) for r in process(holed, *rest, "chunked", **SETTINGS)["band_power"].collect()}
    for pair in range(2):
        difference = X[pair].astype(float) - X[pair + 1].astype(float)
        for b in range(4):
            if b == gone // 2 and gone % 2:
                continue  # the bin's second half is absent: it is a shorter bin, as at the end of a channel
            want = welch(difference[100 * b : 100 * (b + 1)], 100.0, 40, 20, 50.0)["alpha"]
            time, value = power[pair, b, "alpha"]
            assert time == pytest.approx(b + 0.5)
            assert np.isnan(value) if b == gone // 2 else value == pytest.approx(want)


def test_repeated_samples_count_once(spark):
    signals, recs, *rest = stored(spark)
    twice = signals.unionByName(signals.where("channel_pos = 1 and block_idx = 2"))
    plain, doubled = ({(r.pair_idx, r.bin_idx, r.band): r.power for r in process(s, recs, *rest, "chunked", **SETTINGS)["band_power"].collect()} for s in (signals, twice))
    assert doubled == pytest.approx(plain, nan_ok=True)


def test_subtraction_pairs_samples_of_one_time(spark):
    """A block that starts late in one contact is subtracted where both have samples."""
    signals, _, elec, channels = stored(spark)
    late = (F.col("channel_pos") == 1) & (F.col("block_idx") == 2)
    cut = signals.withColumns({"samples": F.when(late, F.slice("samples", 11, 30)).otherwise(F.col("samples")), "start_sample": F.when(late, 110).otherwise(F.col("start_sample"))})
    got = B.sample_rows(bipolar_subtract(cut, channels, bipolar_pairs(elec))).collect()
    assert len(got) == 2 * (400 - 20)
    assert all(r.value == pytest.approx(float(X[r.pair_idx, r.sample_idx]) - float(X[r.pair_idx + 1, r.sample_idx])) for r in got)


def two(spark):
    first = blocks(spark, {"r": list(X)}, 50)
    second = blocks(spark, {"r": list(X[:, :230] * 2)}, 64).withColumn("series_name", F.lit("other"))
    recs = recordings(spark, r=(100.0, 400)).unionByName(recordings(spark, r=(50.0, 230)).withColumn("series_name", F.lit("other")))
    return first.unionByName(second), recs


def test_windows_of_two_series_stay_apart(spark):
    signals, recs = two(spark)
    named = signals.withColumnRenamed("channel_pos", "pair_idx").withColumn("location", F.lit("x"))
    got = {(r.series_name, r.pair_idx, r.window_idx): r.std for r in Q.window_std(named, recs, 0.5).collect()}
    want = {(SERIES_NAME, c, w): X[c, 50 * w : 50 * w + 50].astype(float).std() for c in range(3) for w in range(8)}
    want |= {("other", c, w): (2 * X[c, 25 * w : 25 * w + 25].astype(float)).std() for c in range(3) for w in range(9)}
    assert got == pytest.approx(want, abs=1e-9)


def test_moments_need_no_row_per_sample(spark):
    signals, recs = two(spark)
    named = signals.withColumnRenamed("channel_pos", "pair_idx").withColumn("location", F.lit("x"))
    for frame in (Q.channel_std(signals, ["series_name", "channel_pos"]), Q.trace_layout(signals), Q.signal_stats(signals, ["series_name"])):
        assert "Generate" not in frame._jdf.queryExecution().optimizedPlan().toString()
    plan = Q.window_std(named, recs, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "explode(sequence(" in plan  # pieces of blocks, not samples


def test_moments_of_undefined_samples(spark):
    rows = [("r", "s", 0, 0, 0, [1.0, None, 3.0]), ("r", "s", 0, 1, 3, [5.0]), ("r", "s", 1, 0, 0, [1.0, float("nan")]), ("r", "s", 2, 0, 0, [None])]
    got = {r.channel_pos: r for r in Q.signal_stats(spark.createDataFrame(rows, SIGNAL_TYPE), ["channel_pos"]).collect()}
    assert (got[0].n, got[0].mean, got[0].min, got[0].max) == (4, 3.0, 1.0, 5.0) and got[0].std == pytest.approx(np.std([1, 3, 5]))
    assert all(np.isnan(got[1][c]) for c in ("mean", "min", "max", "std")) and got[2].n == 1 and got[2].mean is None


def test_one_bin_reads_its_blocks_only(spark, tmp_path):
    signals, recs, elec, channels = stored(spark)
    signals.write.parquet(str(tmp_path / "signals"))
    kept = spark.read.schema(signals.schema).parquet(str(tmp_path / "signals"))
    one = bipolar_welch_bin(kept, channels, bipolar_pairs(elec), recs, 2, block_len=50, **SETTINGS)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block_idx,4)" in plan and "LessThanOrEqual(block_idx,5)" in plan
    whole = process(signals, recs, elec, channels, "chunked", **SETTINGS)["band_power"].where("bin_idx = 2")
    got, want = ({(r.pair_idx, r.bin_idx, r.band, r.time_sec): r.power for r in x.collect()} for x in (one, whole))
    assert len(want) == 12 and got == pytest.approx(want, nan_ok=True)
