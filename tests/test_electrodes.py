"""Labels, filters, pairs and pair tables."""

import random

import pytest

from checks import fixtures as X
from leadwave.operators import electrodes as E
from leadwave.operators import pairs as P
from tests import helpers as H
from tests.conftest import SMALL


def pairs_of(frame, run="r"):
    return [r.location for r in P.bipolar_pairs(frame).where(f"run_id = '{run}'").orderBy("pair_idx").collect()]


def test_labels(spark):
    labels = ["RMDT1", "LA012", "rh8", "LTP-7", "REF", "7", "A 1", "A1B2", "", "A99999999999999999999", "É1", "A1 "]
    parsed = {r.location: (r.shaft, r.contact_num) for r in E.parse_electrode_label(H.electrodes(spark, {"r": labels})).collect()}
    assert {k: v for k, v in parsed.items() if v[0]} == {"RMDT1": ("RMDT", 1), "LA012": ("LA", 12), "rh8": ("rh", 8)}
    assert all(v == (None, None) for k, v in parsed.items() if k not in ("RMDT1", "LA012", "rh8"))


def test_null_label_is_unparseable(spark):
    frame = spark.createDataFrame([("r", 1, None)], "run_id string, electrode_id int, location string")
    assert E.unparseable(E.parse_electrode_label(frame)).count() == 1


def test_pairs_need_consecutive_numbers_and_equal_shafts(spark):
    frame = H.electrodes(spark, {"r": ["A1", "A2", "A4", "A5", "B6", "a6", "B7"]})
    assert pairs_of(frame) == ["A1-A2", "A4-A5", "B6-B7"]
    assert [r.location for r in P.skipped_pairs(frame).collect()] == ["A2-A4"]


def test_order_of_rows_does_not_matter(spark):
    labels = [f"{s}{i}" for s in "CAB" for i in (1, 2, 3, 10, 11, 9)]
    expected = None
    for seed in range(3):
        rows = [("r", 100 + i, label) for i, label in enumerate(labels)]
        random.Random(seed).shuffle(rows)
        got = P.bipolar_pairs(spark.createDataFrame(rows, "run_id string, electrode_id int, location string")).orderBy("pair_idx").collect()
        names = [r.location for r in got]
        assert names == [f"{s}{a}-{s}{a + 1}" for s in "ABC" for a in (1, 2, 9, 10)]
        assert expected is None or [(r.anode_id, r.cathode_id) for r in got] == expected
        expected = [(r.anode_id, r.cathode_id) for r in got]


def test_repeated_contact_follows_the_row_rule(spark):
    frame = H.electrodes(spark, {"r": ["A1", "A1", "A2", "A2", "A3"]})
    got = [(r.anode_id, r.cathode_id) for r in P.bipolar_pairs(frame).orderBy("pair_idx").collect()]
    assert got == [(101, 102), (103, 104)]
    assert P.skipped_pairs(frame).count() == 2


def test_runs_do_not_mix(spark):
    frame = H.electrodes(spark, {"r": ["A1", "A3"], "s": ["A2", "A3"]})
    assert pairs_of(frame) == [] and pairs_of(frame, "s") == ["A2-A3"]


@pytest.mark.parametrize("choose, parseable, pairs, skipped", [
    (lambda e: e, 62, 51, 2),
    (E.out_of_brain_filter, 60, 47, 4),
    (E.exclude_label_filter, 60, 47, 4),
])
def test_counts_of_the_long_recording(spark, choose, parseable, pairs, skipped):
    frame = choose(X.emb_electrodes(spark, SMALL))
    parsed = E.drop_unparseable(E.parse_electrode_label(frame))
    assert parsed.count() == parseable and parsed.select("shaft").distinct().count() == 9
    assert P.bipolar_pairs(frame).count() == pairs and P.skipped_pairs(frame).count() == skipped


def test_filters_without_the_columns_keep_everything(spark):
    frame = H.electrodes(spark, {"r": ["A1", "A2"]})
    assert E.exclude_label_filter(frame).count() == 2
    assert E.out_of_brain_filter(frame).count() == 2
    assert E.out_of_brain_filter(H.electrodes(spark, {"r": ["A1"]}, Destrieux="x oUt Of BrAiN y")).count() == 0


def test_pair_tables_follow_the_columns(spark):
    rows = [("r", 100, "A1", "g", 2.0, None, 5), ("r", 101, "A2", "h", 4.0, 8.0, 6), ("r", 102, "A3", "i", None, float("nan"), 7)]
    frame = spark.createDataFrame(rows, "run_id string, electrode_id int, location string, group string, MNI_coord_1 double, MNI_coord_2 double, impedance int")
    pairs = P.bipolar_pairs(frame)
    averaged = P.bipolar_table(frame, pairs).orderBy("pair_idx")
    assert averaged.columns == ["run_id", "pair_idx", "location", "group", "MNI_coord_1", "MNI_coord_2", "impedance_anode", "impedance_cathode"]
    assert [tuple(r)[3:] for r in averaged.collect()] == [("g", 3.0, 8.0, 5, 6), ("h", 4.0, 8.0, 6, 7)]
    suffixed = P.bipolar_table(frame, pairs, "suffixed").orderBy("pair_idx").collect()
    assert suffixed[1].MNI_coord_2_anode == 8.0 and suffixed[1].MNI_coord_2_cathode is None
    with pytest.raises(ValueError):
        P.bipolar_table(frame.drop("group"), pairs, "suffixed")
    assert P.bipolar_table(frame.drop("group"), pairs).count() == 2


def test_electrode_counts(spark):
    frame = H.electrodes(spark, {"r": ["A1", "A2", "A3", "X", "B1"], "s": ["Q"]})
    rows = {r.run_id: r for r in E.electrode_counts(frame, P.bipolar_pairs(frame)).collect()}
    assert (rows["r"].n_electrodes, rows["r"].n_unparseable, rows["r"].n_shafts, rows["r"].n_pairs) == (5, 1, 2, 2)
    assert (rows["s"].n_usable, rows["s"].n_shafts, rows["s"].n_pairs) == (0, 0, 0)
