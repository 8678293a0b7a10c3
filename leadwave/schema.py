"""Table layouts and fixed values shared by the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Frequency bands in Hz, half-open [fmin, fmax). No band covers 12-15 Hz.
BANDS = {
    "delta": (1.0, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 12.0),
    "beta": (15.0, 25.0),
    "gamma": (25.0, 70.0),
    "high_gamma": (70.0, 170.0),
}

# Coordinate systems and axes of the electrode table.
COORDINATE_SYSTEMS = ["MNI", "LEPTO", "MGRID", "subINF", "fsaverageINF", "ScannerNativeRAS"]
COORDINATE_COLUMNS = [f"{system}_coord_{axis}" for system in COORDINATE_SYSTEMS for axis in (1, 2, 3)]

# Label columns searched for electrodes outside the brain.
ANATOMY_COLUMNS = [
    "location",
    "FS_label",
    "Desikan_Killiany",
    "Destrieux",
    "JP_label_original",
    "JP_label_std",
]

# Output names and texts of a processed run.
SERIES_NAME = "ElectricalSeries_sEEG"
SESSION_SUFFIX = " - bipolar referenced, band power computed"
IDENTIFIER_SUFFIX = "_bipolar_psd"
DEVICE_NAME = "NihonKohden"
DEVICE_DESCRIPTION = "Nihon Kohden EEG-1200A"
GROUP_NAME = "sEEG_bipolar"
GROUP_DESCRIPTION = "Bipolar referenced sEEG electrodes (anode-cathode pairs)"
GROUP_LOCATION = "multiple"
POWER_METRIC = "power"
POWER_UNIT = "V^2/Hz"

SUBJECT = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("subject_id", "age", "sex", "species", "description")]
)

RECORDINGS = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("subject_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("series_name", T.StringType()),
        T.StructField("sfreq", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("n_channels", T.IntegerType()),
        T.StructField("session_description", T.StringType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("session_start_time", T.TimestampType()),
        T.StructField("timestamps_reference_time", T.TimestampType()),
        T.StructField("experimenter", T.StringType()),
        T.StructField("lab", T.StringType()),
        T.StructField("institution", T.StringType()),
        T.StructField("subject", SUBJECT),
    ]
)

# One row per channel and block. All channels of a run share the block boundaries:
# start_sample = block_idx * block length; only the last block of a channel may be shorter.
SIGNALS = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("series_name", T.StringType(), False),
        T.StructField("channel_pos", T.IntegerType(), False),
        T.StructField("block_idx", T.LongType(), False),
        T.StructField("start_sample", T.LongType(), False),
        T.StructField("samples", T.ArrayType(T.FloatType()), False),
    ]
)

CHANNEL_MAP = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("channel_pos", T.IntegerType(), False),
        T.StructField("electrode_id", T.IntegerType(), False),
    ]
)

BAND_POWER = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("bin_idx", T.LongType(), False),
        T.StructField("time_sec", T.DoubleType(), False),
        T.StructField("pair_idx", T.IntegerType(), False),
        T.StructField("location", T.StringType()),
        T.StructField("band", T.StringType(), False),
        T.StructField("power", T.DoubleType()),
    ]
)

BANDS_SCHEMA = T.StructType(
    [
        T.StructField("band", T.StringType(), False),
        T.StructField("fmin", T.DoubleType(), False),
        T.StructField("fmax", T.DoubleType(), False),
        T.StructField("band_idx", T.IntegerType(), False),
    ]
)


def bands_frame(spark: SparkSession, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """The band definitions as a table of one row per band."""
    rows = [(name, float(lo), float(hi), i) for i, (name, (lo, hi)) in enumerate(bands.items())]
    return spark.createDataFrame(rows, BANDS_SCHEMA)

#: One row for each attempt at a run, appended when all its tables are written.
LEDGER = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("generation", T.StringType()),
    T.StructField("settings_key", T.StringType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("committed_at", T.TimestampType()),
])
