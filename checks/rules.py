"""How recordings and electrodes are derived from the test tables, as SQL both engines read.

Fixed values of the test data: run lengths, channel counts, rates, and the electrode irregularities.
"""

from __future__ import annotations

EV_RUN = 5000
EV_CHANNELS = 24
EV_SCALE = 1024
SECOND_SERIES = "ElectricalSeries_ECoG"

SHAFTS = ["LA", "LANT", "LH", "RA", "RMDT", "RH", "ROF", "LTP"]


def label(gap: str = "pos = 13", twin: str = "1 = 0") -> str:
    """Electrode label at pos 0..63: a gap, an optional repeated contact, lower case and unparseable ones."""
    shaft = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SHAFTS))
    number = f"CASE WHEN {gap} THEN pos % 8 + 11 WHEN {twin} THEN pos % 8 ELSE pos % 8 + 1 END"
    return (
        "CASE WHEN pos = 47 THEN 'rh8' WHEN pos = 62 THEN 'LTP-7' WHEN pos = 63 THEN 'REF' ELSE "
        f"(CASE CAST(floor(pos / 8) AS INT) {shaft} END) || CAST({number} AS STRING) END"
    )


# Electrodes of the one long recording: 64 contacts, id, position and order all different.
EMB_ELECTRODES = {
    "electrode_id": "CAST(100 + pos AS INT)",
    "location": label(),
    "grp": "CASE WHEN pos >= 56 THEN 'g2' ELSE 'g1' END",
    "group_name": "CASE WHEN pos >= 56 THEN 'sEEG2' ELSE 'sEEG' END",
    "FS_label": "CASE WHEN pos = 20 THEN 'Out of Brain' ELSE 'ctx-' || CAST(pos % 5 AS STRING) END",
    "JP_label_original": "CASE WHEN pos IN (20, 36) THEN 'Out of Brain' WHEN pos % 11 = 0 THEN NULL ELSE 'grey' END",
    "std_label_keller": "CASE WHEN pos IN (5, 36) THEN 'EXCLUDE' WHEN pos % 10 = 0 THEN NULL ELSE 'KEEP' END",
    "MNI_coord_1": "CASE WHEN pos % 9 = 0 THEN NULL ELSE CAST(pos * 1.5 AS DOUBLE) END",
    "MNI_coord_2": "CASE WHEN pos % 9 = 0 OR pos % 4 = 1 THEN NULL ELSE CAST(pos * 0.5 - 3 AS DOUBLE) END",
    "MNI_coord_3": "CASE WHEN pos % 9 = 0 THEN NULL ELSE CAST(40 - pos AS DOUBLE) END",
}

# Electrodes of many recordings: every part is a contact, 64 of them make a run.
PART_RUN = "'part-' || CAST(CAST(floor(p_partkey / 64) AS BIGINT) AS STRING)"
PART_POS = "CAST(p_partkey % 64 AS INT)"
PART_ELECTRODES = {
    "electrode_id": "CAST(100 + pos AS INT)",
    "location": label(twin="pos = 27"),
    "grp": "p_type",
    "group_name": "CASE WHEN p_size > 40 THEN 'sEEG2' ELSE 'sEEG' END",
    "FS_label": "CASE WHEN p_size = 7 THEN 'Out of Brain' WHEN p_size = 8 THEN 'mostly OUT of brain, ' || p_type ELSE p_type END",
    "Desikan_Killiany": "CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_brand END",
    "JP_label_original": "CASE WHEN p_size IN (9, 36) THEN 'Out of Brain' WHEN pos % 11 = 0 THEN NULL ELSE 'grey' END",
    "std_label_keller": "CASE WHEN p_size = 5 THEN 'EXCLUDE' WHEN pos % 10 = 0 THEN NULL ELSE 'KEEP' END",
    "MNI_coord_1": "CASE WHEN pos % 9 = 0 THEN NULL ELSE p_retailprice END",
    "MNI_coord_2": "CASE WHEN pos % 9 = 0 OR pos % 4 = 1 THEN NULL ELSE CAST(p_size * 0.5 - 3 AS DOUBLE) END",
    "LEPTO_coord_1": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END",
    "vendor_name": "p_name",
}

EV_ELECTRODES = {
    "electrode_id": "CAST(500 + channel_pos AS INT)",
    "location": "(CASE WHEN channel_pos < 12 THEN 'EVA' ELSE 'EVB' END) || CAST(channel_pos % 12 + 1 AS STRING)",
}

# Input files of many runs: every customer is a recording.
RUN_PATH = (
    "'/data/sub-' || CAST(200 + c_custkey % 40 AS STRING) || '/ses-0' || CAST(1 + c_custkey % 2 AS STRING) || '/ieeg/sub-' "
    "|| CAST(200 + c_custkey % 40 AS STRING) || '_ses-0' || CAST(1 + c_custkey % 2 AS STRING) || '_run-R' "
    "|| CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 17 = 0 THEN '.edf' ELSE '.nwb' END"
)
RESULT_PATH = (
    "'/data/sub-' || CAST(200 + c_custkey % 40 AS STRING) || '/ses-0' || CAST(1 + c_custkey % 2 AS STRING) || '/preprocessed/sub-' "
    "|| CAST(200 + c_custkey % 40 AS STRING) || '_ses-0' || CAST(1 + c_custkey % 2 AS STRING) || '_run-R' "
    "|| CAST(c_custkey AS STRING) || '_bipolar_psd.nwb'"
)
