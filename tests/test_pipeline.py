"""Whole pipelines: presets, status, storing, and the physical plans."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadwave.operators import pairs as P
from leadwave.operators.rereference import bipolar_subtract, pair_blocks
from leadwave.plans import pipeline as PL
from leadwave.session import broadcast_if_small, scratch_path
from leadwave.sources import catalog as K
from leadwave.sources import tables as D
from tests import helpers as H

FS = 400.0
LABELS = ["A1", "A2", "A3", "B1", "B2"]


def inputs(spark, runs=("r",), n=600, labels=LABELS):
    rng = np.random.default_rng(0)
    signals = H.blocks(spark, {run: [rng.standard_normal(n) for _ in labels] for run in runs}, 150)
    electrodes = H.electrodes(spark, {run: labels for run in runs}, group="g", Destrieux="grey").withColumn(
        "Destrieux", F.when(F.col("location") == "A2", "out of BRAIN").otherwise(F.col("Destrieux"))
    ).withColumn("MNI_coord_1", F.col("electrode_id").cast("double"))
    return signals, H.recordings(spark, **{run: (FS, n) for run in runs}), electrodes, H.channel_map(electrodes)


def locations(results):
    return [r.location for r in results["electrodes"].orderBy("pair_idx").collect()]


def test_presets_differ_as_documented(spark):
    data = inputs(spark)
    chunked = PL.process(*data, "chunked", nperseg=100, bin_sec=0.5)
    whole = PL.process(*data, "whole_file", nperseg=100)
    plain = PL.process(*data, "rereferencing", nperseg=100)
    brain = PL.process(*data, "in_brain", window_sec=0.25, overlap_sec=0.125)
    assert locations(chunked) == locations(whole) == locations(plain) == ["A1-A2", "A2-A3", "B1-B2"]
    assert locations(brain) == ["B1-B2"]
    assert {"MNI_coord_1_anode", "shaft_cathode", "contact_num_anode"} <= set(chunked["electrodes"].columns)
    assert "MNI_coord_1" in whole["electrodes"].columns and "shaft_anode" in whole["electrodes"].columns
    assert "MNI_coord_1" in plain["electrodes"].columns and "shaft_anode" not in plain["electrodes"].columns
    assert chunked["band_power"].select("bin_idx").distinct().count() == 3
    assert whole["band_power"].select("bin_idx").distinct().count() == 11
    assert brain["band_power"].count() == 11 * 6


def test_presets_are_checked():
    with pytest.raises(ValueError):
        PL.settings("other")
    with pytest.raises(ValueError):
        PL.settings("chunked", npersegs=3)
    assert PL.settings("chunked")["nperseg"] == 2000 and PL.settings("in_brain", window_sec=2.0)["window_sec"] == 2.0


def test_block_length_does_not_change_the_result(spark):
    x = [np.random.default_rng(i).standard_normal(500) for i in range(5)]
    _, recordings, electrodes, channels = inputs(spark, n=500)
    results = []
    for block_len in (37, 200, 1000):
        frame = PL.process(H.blocks(spark, {"r": x}, block_len), recordings, electrodes, channels, "chunked", nperseg=64, bin_sec=0.3)["band_power"]
        results.append({(r.bin_idx, r.pair_idx, r.band): r.power for r in frame.collect()})
    assert results[0].keys() == results[1].keys() == results[2].keys()
    for key, value in results[0].items():
        assert all(other[key] == (None if value is None else pytest.approx(value, rel=1e-10)) for other in results[1:])


def test_unsound_runs_are_reported_and_left_out(spark):
    good = inputs(spark)
    alone = inputs(spark, ("alone",), labels=["A1", "B3", "X"])
    short = inputs(spark, ("short",), n=40)
    twice = inputs(spark, ("twice",))
    twice = (*twice[:3], twice[3].unionAll(twice[3].limit(1)))
    data = [a.unionByName(b).unionByName(c).unionByName(d) for a, b, c, d in zip(good, alone, short, twice)]
    results = PL.process(*data, "whole_file", nperseg=100)
    status = {r.run_id: (r.status, r.reason) for r in results["status"].collect()}
    assert status == {
        "r": ("succeeded", None), "alone": ("failed", "no bipolar pairs"), "short": ("failed", "recording too short"),
        "twice": ("failed", "electrode or channel listed twice"),
    }
    for name in ("band_power", "electrodes", "sessions"):
        assert {r.run_id for r in results[name].select("run_id").distinct().collect()} == {"r"}


def test_stored_results_and_parameters(spark):
    root = scratch_path(spark, "stored")
    PL.store(PL.process(*inputs(spark, ("a", "b")), "chunked", nperseg=100, bin_sec=0.5), root)
    power = D.scan_band_power(spark, root)
    assert power.count() == 2 * 3 * 3 * 6
    sessions = {r.run_id: r for r in D.read_table(spark, root, "sessions").collect()}
    params = json.loads(sessions["a"].params)
    assert sessions["a"].identifier == "a_bipolar_psd" and sessions["a"].unit == "V^2/Hz"
    assert (params["nperseg"], params["noverlap"], params["n_time_bins"], params["n_bipolar_pairs"]) == (100, 50, 3, 3)
    assert params["output_sampling_rate"] == 2.0 and params["detrend"] == "constant" and params["frequency_bands"]["beta"] == [15.0, 25.0]
    assert [r.band for r in D.bands_table(spark, root).orderBy("band_idx").collect()][0] == "delta"
    limits = D.band_limits_map(D.bands_table(spark, root)).collect()[0]
    assert limits.names[-1] == "high_gamma" and limits.band_limits["alpha"].fmax == 12.0

    D.write_band_power(PL.process(*inputs(spark, ("b",)), "chunked", nperseg=100, bin_sec=1.0)["band_power"], root)
    bins = {r.run_id: r.n for r in D.scan_band_power(spark, root).groupBy("run_id").agg(F.countDistinct("bin_idx").alias("n")).collect()}
    assert bins == {"a": 3, "b": 2}


def test_run_discovery(spark):
    paths = ["/d/sub-259/ses-01/ieeg/sub-259_ses-01_run-A.nwb", "/d/sub-260/ses-01/ieeg/sub-260_ses-01_run-B.nwb",
             "/d/sub-260/ses-01/ieeg/sub-260_ses-01_run-B.edf", "/d/sub-260/ses-01/anat/sub-260_ses-01_run-B.nwb",
             "/d/sub-261/ses-01/ieeg/sub-262_ses-01_run-C.nwb", "/d/sub-260/ses-01/x/ieeg/sub-260_ses-01_run-D.nwb"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    names = lambda f: sorted(r.input_path[3:10] for r in f.collect())
    assert names(K.discover_runs(frame)) == ["sub-259", "sub-260", "sub-261"]
    assert names(K.discover_runs(frame, "259")) == names(K.discover_runs(frame, ["sub-259"])) == ["sub-259"]
    assert names(K.discover_runs(frame, ["260", "sub-260"])) == ["sub-260", "sub-260"]
    assert names(K.discover_runs(frame, ["260", "sub-260"], distinct=True)) == ["sub-260"]
    assert names(K.discover_runs(frame, ["261", "262"])) == []
    runs = K.discover_runs(frame)
    done = spark.createDataFrame([("/d/sub-259/ses-01/preprocessed/sub-259_ses-01_run-A_bipolar_psd.nwb",)], "output_path string")
    assert names(K.pending_runs(runs, done)) == ["sub-260", "sub-261"] and K.pending_runs(runs, done, overwrite=True).count() == 3
    assert [r.n_more for r in K.preview(runs, 2).collect()] == [1, 1]


def test_paths_are_listed_from_storage(spark, tmp_path):
    for name in ("sub-1/ses-01/ieeg/sub-1_ses-01_run-A.nwb", "sub-1/ses-01/ieeg/sub-1_ses-01_run-A.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert K.discover_runs(K.list_paths(spark, str(tmp_path))).count() == 1


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_the_signal_is_shuffled_once(spark):
    root = scratch_path(spark, "plan")
    signals, recordings, electrodes, channels = inputs(spark)
    D.write_signals(signals, root)
    stored = D.read_table(spark, root, "signals")
    text = plan(PL.process(stored, recordings, electrodes, channels, "chunked", nperseg=100)["band_power"])
    assert text.count("Exchange hashpartitioning") == 1 and text.count("BroadcastHashJoin") == 1
    assert text.count("ArrowEvalPython") == 1


def test_bucketed_signals_are_not_shuffled(spark):
    signals, _, electrodes, channels = inputs(spark)
    D.save_signals_bucketed(signals, "bucketed_signals", 4)
    try:
        paired = pair_blocks(spark.table("bucketed_signals"), channels, P.bipolar_pairs(electrodes))
        assert "Exchange hashpartitioning" not in plan(paired)
        assert paired.count() == 3 * 4
    finally:
        spark.sql("DROP TABLE bucketed_signals")


def powers(frame):
    return {(r.bin_idx, r.pair_idx, r.band): r.power for r in frame.collect()}


@pytest.mark.parametrize("preset, chosen, co_partition", [
    ("chunked", {"nperseg": 100, "bin_sec": 0.5}, "true"), ("whole_file", {"nperseg": 100}, "false"),
])
def test_many_members_meet_the_signal_in_its_shuffle(spark, monkeypatch, preset, chosen, co_partition):
    from leadwave.operators import rereference

    root = scratch_path(spark, "members")
    signals, *metadata = inputs(spark, ("a", "b"))
    D.write_signals(signals, root)
    stored = D.read_table(spark, root, "signals")
    expected = powers(PL.process(stored, *metadata, preset, **chosen)["band_power"])
    monkeypatch.setattr(rereference, "is_small", lambda df: "channel_pos" not in df.columns)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", co_partition)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frame = PL.process(stored, *metadata, preset, **chosen)["band_power"]
        text, got = plan(frame), powers(frame)
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == expected
    if co_partition == "false":
        assert text.count("Exchange hashpartitioning") == 2 and text.count("REPARTITION_BY_COL") == 2


def test_aligned_bucketed_blocks_reach_band_power_without_shuffle(spark):
    signals, *metadata = inputs(spark)
    D.save_signals_bucketed(signals, "bucketed_bins", 4)
    try:
        stored = spark.table("bucketed_bins")
        chosen = {"nperseg": 50, "bin_sec": 150 / FS}
        frame = PL.process(stored, *metadata, "chunked", aligned=True, **chosen)["band_power"]
        assert "Exchange hashpartitioning" not in plan(frame)
        assert powers(frame) == powers(PL.process(stored, *metadata, "chunked", **chosen)["band_power"])
        with pytest.raises(Exception, match="not cut to the bins"):
            PL.process(stored, *metadata, "chunked", aligned=True, nperseg=50, bin_sec=0.25)["band_power"].collect()
    finally:
        spark.sql("DROP TABLE bucketed_bins")


def test_slices_are_pushed_to_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    root = scratch_path(spark, "pushed")
    D.write_signals(inputs(spark)[0], root)
    text = plan(D.scan_signal_slice(D.read_table(spark, root, "signals"), 160, 290, n_channels=2, block_len=150))
    for pushed in ("GreaterThanOrEqual(block_idx,1)", "LessThanOrEqual(block_idx,1)", "LessThan(channel_pos,2)", "LessThan(start_sample,290)"):
        assert pushed in text


def test_large_metadata_is_not_broadcast(spark):
    small, large = spark.range(5), spark.range(50)
    big = spark.range(1000).repartition(3)
    assert "BroadcastHashJoin" in plan(big.join(broadcast_if_small(small, 100), "id"))
    assert broadcast_if_small(large, 100) is large


def test_the_join_without_broadcast_gives_the_same(spark, monkeypatch):
    from leadwave.operators import rereference

    signals, _, electrodes, channels = inputs(spark)
    pairs = P.bipolar_pairs(electrodes)
    expected = bipolar_subtract(signals, channels, pairs).orderBy("pair_idx", "block_idx").collect()
    monkeypatch.setattr(rereference, "is_small", lambda df: False)
    assert bipolar_subtract(signals, channels, pairs).orderBy("pair_idx", "block_idx").collect() == expected


def test_no_plan_moves_a_recording_by_its_name_alone(spark, monkeypatch, tmp_path):
    from leadwave import session
    from leadwave.operators import blocks as B
    from leadwave.operators import rereference, selection, spectrum, stats

    signals, recordings, electrodes, channels = inputs(spark)
    D.write_signals(signals, str(tmp_path))
    stored = D.read_table(spark, str(tmp_path), "signals")
    pairs = P.bipolar_pairs(electrodes)
    names = channels.join(electrodes, ["run_id", "electrode_id"])

    def frames():
        paired = stored.withColumnRenamed("channel_pos", "pair_idx").withColumn("location", F.lit("A1-A2"))
        return {
            "relayout": spectrum.relayout(paired, spectrum.welch_layout(recordings, 50, 0.5, 0.5)),
            "time_bins": spectrum.time_bins(stored, recordings, 0.5),
            "window_std": stats.window_std(paired, recordings, 0.25),
            "segment_select": selection.segment_select(stored, recordings, 0.01),
            "channel_arrays": B.channel_arrays(stored, names),
            "bipolar_subtract": bipolar_subtract(stored, channels, pairs),
            "process": PL.process(stored, recordings, electrodes, channels, "chunked", nperseg=100, bin_sec=0.5)["band_power"],
        }

    expected = {name: sorted(map(str, frame.collect())) for name, frame in frames().items()}
    for module in (session, rereference):
        monkeypatch.setattr(module, "is_small", lambda df, max_bytes=0: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, frame in frames().items():
            for line in plan(frame).splitlines():
                assert "Exchange hashpartitioning(run_id#" not in line or line.split("hashpartitioning(")[1].count("#") > 1 and "channel_pos#" not in line.split("), ")[0].replace("_part", "") or "_part#" in line or "block_idx#" in line, (name, line)
            assert sorted(map(str, frame.collect())) == expected[name], name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_status_lists_every_run_and_series(spark):
    signals, recordings, electrodes, channels = inputs(spark, ("r", "lost", "double", "two"))
    other = signals.where("run_id = 'two'").withColumn("series_name", F.lit("other"))
    twice = recordings.unionAll(recordings.where("run_id = 'double'")).where("run_id != 'lost'")
    results = PL.process(signals.unionByName(other), twice, electrodes, channels, "chunked", nperseg=100, bin_sec=0.5)
    assert {r.run_id: r.reason for r in results["status"].collect()} == {
        "r": None, "lost": "no recordings row", "double": "recording listed twice", "two": "more than one series",
    }
    assert {r.run_id for r in results["band_power"].select("run_id").distinct().collect()} == {"r"}
    name = signals.first().series_name
    one = PL.process(signals.unionByName(other), recordings, electrodes, channels, "chunked", series_name=name, nperseg=100, bin_sec=0.5)
    assert one["band_power"].where("run_id = 'two'").count() == 3 * 3 * 6


def test_stored_parameters_are_those_of_the_result(spark):
    root = scratch_path(spark, "settings")
    PL.store(PL.process(*inputs(spark), "whole_file", nperseg=50), root)
    params = json.loads(D.read_table(spark, root, "sessions").first().params)
    assert (params["method"], params["nperseg"], params["output_sampling_rate"]) == ("stft", 50, 16.0)
    assert params["time_bin_method"] == "hopping" and "chunk_duration_sec" not in params


def test_pending_runs_are_processed_once(spark):
    root = scratch_path(spark, "pending")
    data, chosen = inputs(spark, ("a", "b")), {"nperseg": 100, "bin_sec": 0.5}
    runs = spark.createDataFrame([("a",), ("lost",)], "run_id string")

    def status(runs, **how):
        return {r.run_id: r.status for r in PL.process_pending(runs, *data, root, "chunked", **chosen, **how).collect()}

    def written():
        return {r.run_id: r.t for r in spark.read.parquet(f"{root}/band_power").groupBy("run_id").agg(F.max("_metadata.file_modification_time").alias("t")).collect()}

    assert status(runs) == {"a": "succeeded", "lost": "failed"}
    first = written()
    both = spark.createDataFrame([("a",), ("b",), ("b",)], "run_id string")
    assert status(both) == {"a": "succeeded", "b": "succeeded"}
    second = written()
    assert second["a"] == first["a"] and set(second) == {"a", "b"}
    assert status(both) == {"a": "succeeded", "b": "succeeded"} and written() == second
    assert status(both, overwrite=True) == {"a": "succeeded", "b": "succeeded"} and written()["a"] > first["a"]


def test_a_broken_write_leaves_the_old_result_and_an_empty_one_counts_as_failed(spark, monkeypatch):
    root = scratch_path(spark, "generations")
    data, chosen = inputs(spark, ("a", "7")), {"nperseg": 100, "bin_sec": 0.5}
    runs = spark.createDataFrame([("a",), ("7",)], "run_id string")

    def ask(**how):
        return {r.run_id: r.status for r in PL.process_pending(runs, *data, root, "chunked", **chosen, **how).collect()}

    def power():
        return sorted(map(tuple, D.scan_band_power(spark, root).collect()))

    assert ask() == {"a": "succeeded", "7": "succeeded"}
    before = power()
    assert {r[0] for r in before} == {"a", "7"}

    with monkeypatch.context() as broken:
        broken.setattr(PL, "write_bands", lambda *args: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            ask(overwrite=True)
    assert power() == before and D.read_ledger(spark, root).count() == 2
    assert ask() == {"a": "succeeded", "7": "succeeded"} and D.read_ledger(spark, root).count() == 2

    results = PL.process(*data, "chunked", **chosen)
    PL.store({**results, "band_power": results["band_power"].where("run_id <> 'a'")}, root)
    assert {r.run_id: (r.status, r.reason) for r in D.read_status(spark, root).collect()} == {"a": ("failed", "no result stored"), "7": ("succeeded", None)}
    assert power() == [r for r in before if r[0] == "7"]
    PL.store({**results, "band_power": results["band_power"].where("false")}, root)
    assert {r.status for r in D.read_status(spark, root).collect()} == {"failed"} and power() == []


def test_changed_settings_and_changed_inputs_are_processed_again(spark):
    root, data = scratch_path(spark, "ledger"), inputs(spark, ("a", "b"))

    def attempts(times, **chosen):
        runs = spark.createDataFrame(list(times.items()), "run_id string, modified string")
        PL.process_pending(runs, *data, root, "chunked", bin_sec=0.5, **chosen).collect()
        return {r.run_id: r["count"] for r in D.read_ledger(spark, root).groupBy("run_id").count().collect()}

    monday, tuesday = "2024-01-01 10:00:00", "2024-01-02 10:00:00"
    assert attempts({"a": monday, "b": monday}, nperseg=100) == {"a": 1, "b": 1}
    assert attempts({"a": monday, "b": tuesday}, nperseg=100) == {"a": 1, "b": 2}
    assert attempts({"a": monday, "b": None}, nperseg=100) == {"a": 1, "b": 2}
    assert attempts({"a": monday, "b": tuesday}, nperseg=50) == {"a": 2, "b": 3}
    assert D.scan_band_power(spark, root).groupBy("run_id", "bin_idx", "pair_idx", "band").count().where("count > 1").isEmpty()
