"""One query per operator: the Spark job and, where SQL can express it, the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from checks import oracle as O
from leadwave.functions.labels import pair_label, result_path
from leadwave.functions.timeaxis import sample_minutes, to_microvolt
from leadwave.operators import blocks as B
from leadwave.operators import electrodes as E
from leadwave.operators import metadata as M
from leadwave.operators import pairs as P
from leadwave.operators import selection as C
from leadwave.operators import spectrum as W
from leadwave.operators import stats as Q
from leadwave.operators.rereference import bipolar_subtract
from leadwave.plans import bandpower as BP
from leadwave.plans import pipeline as PL
from leadwave.plans import reports as RP
from leadwave.schema import bands_frame
from leadwave.session import scratch_path
from leadwave.sources import catalog as K
from leadwave.sources import tables as D

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return register


def R(value: Column | str, digits: int = 9) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


# The settings the queries use: windows and bins small enough for recordings of some hundred samples.
WELCH = {"nperseg": 200, "overlap": 0.25, "bin_sec": 0.5, "max_freq": 200.0}
WELCH_ALL = {"nperseg": 64, "overlap": 0.5, "bin_sec": 0.25, "max_freq": 250.0}
HOP = {"nperseg": 200, "overlap": 0.5}
HOP_ALL = {"nperseg": 50, "overlap": 0.5}
WINDOW_SEC = 0.125
SEGMENT_SEC = 0.25
MIN_LEN = "CAST(floor({m} * 60 * sfreq) AS BIGINT)"


def emb_bipolar(s: SparkSession, d: str, signals: DataFrame | None = None) -> DataFrame:
    pairs = P.bipolar_pairs(X.emb_electrodes(s, d))
    return bipolar_subtract(X.emb_signals(s, d) if signals is None else signals, X.emb_channel_map(s, d), pairs)


def drop_bipolar(s: SparkSession, d: str) -> DataFrame:
    return emb_bipolar(s, d, X.drop_signals(s, d))


def all_bipolar(s: SparkSession, d: str) -> DataFrame:
    return bipolar_subtract(X.signals(s, d), X.channel_map(s, d), P.bipolar_pairs(X.electrodes(s, d)))


def rounded_power(power: DataFrame) -> DataFrame:
    return power.select("run_id", "bin_idx", R("time_sec").alias("time_sec"), "pair_idx", "location", "band", R("power", 10).alias("power"))


def all_power(s: SparkSession, d: str) -> DataFrame:
    """Welch band power of every recording, with one shuffle of the signal."""
    layout = W.welch_layout(X.recordings(s, d), WELCH_ALL["nperseg"], WELCH_ALL["overlap"], WELCH_ALL["bin_sec"])
    pairs = P.bipolar_pairs(X.electrodes(s, d))
    return BP.bipolar_bandpower(X.signals(s, d), X.channel_map(s, d), pairs, layout, "welch", max_freq=WELCH_ALL["max_freq"])


ALL_POWER = O.welch_power("all", **WELCH_ALL)


# --- scans, sources, sinks ------------------------------------------------------------------------


@query("scan_signals", O.sql("SELECT run_id, channel_pos, sample_idx, value FROM sig", "sig"))
def scan_signals(s, d):
    return B.sample_rows(D.scan_signals(X.signals(s, d))).select("run_id", "channel_pos", "sample_idx", "value")


@query("scan_signal_slice", O.sql(
    "SELECT run_id, channel_pos, sample_idx, value FROM sig_emb WHERE sample_idx >= 100 AND sample_idx < 260 AND channel_pos < 8", "sig_emb"))
def scan_signal_slice(s, d):
    part = D.scan_signal_slice(X.emb_signals(s, d), 100, 260, n_channels=8, block_len=X.EMB_BLOCK)
    return B.sample_rows(part).select("run_id", "channel_pos", "sample_idx", "value")


@query("scan_electrodes", O.sql("SELECT * FROM elec_part", "elec_part"))
def scan_electrodes(s, d):
    return X.part_electrodes(s, d)


@query("electrode_group_filter", O.sql("SELECT run_id, electrode_id, location FROM elec_part WHERE group_name = 'sEEG'", "elec_part"))
def electrode_group_filter(s, d):
    return E.electrode_group_filter(X.part_electrodes(s, d)).select("run_id", "electrode_id", "location")


@query("series_summary", O.sql(
    f"SELECT run_id, {O.SERIES} AS series_name, n_samples, n_channels, sfreq, round(n_samples / sfreq / 60, 9) AS duration_min, "
    "round(n_samples * n_channels * 4 / 1073741824.0::DOUBLE, 12) AS size_gib FROM rec", "rec"))
def series_summary(s, d):
    return M.series_summary(X.measured(s, d)).withColumns({"duration_min": R("duration_min"), "size_gib": R("size_gib", 12)})


@query("channel_arrays", O.sql(
    "SELECT s.run_id, e.location AS channel_name, 'seeg' AS ch_type, s.sample_idx, s.value FROM sig s "
    "JOIN cmap_all m ON m.run_id = s.run_id AND m.channel_pos = s.channel_pos "
    "JOIN elec_all e ON e.run_id = m.run_id AND e.electrode_id = m.electrode_id", "sig", "cmap_all", "elec_all"))
def channel_arrays(s, d):
    names = E.channel_electrode_join(X.channel_map(s, d), X.electrodes(s, d))
    return B.sample_rows(B.channel_arrays(X.signals(s, d), names)).select("run_id", "channel_name", "ch_type", "sample_idx", "value")


def _stored(s: SparkSession, d: str, name: str) -> str:
    root = scratch_path(s, name)
    D.write_band_power(all_power(s, d), root)
    return root


@query("scan_band_power", O.sql(O.ROUNDED_POWER, *ALL_POWER))
def scan_band_power(s, d):
    return rounded_power(D.scan_band_power(s, _stored(s, d, "scan")))


@query("write_band_power", O.sql("SELECT run_id, band, count(*) AS n, count(power) AS n_known, round(sum(power), 9) + 0.0 AS total FROM power GROUP BY ALL", *ALL_POWER))
def write_band_power(s, d):
    stored = D.scan_band_power(s, _stored(s, d, "write"))
    return stored.groupBy("run_id", "band").agg(
        F.count(F.lit(1)).alias("n"), F.count("power").alias("n_known"), R(F.sum("power")).alias("total"))


@query("bands_table", O.sql(
    "SELECT p.run_id, p.band, d.fmin, d.fmax, count(*) AS n_values FROM power p JOIN bands d ON d.band = p.band GROUP BY ALL", *ALL_POWER))
def bands_table(s, d):
    root = _stored(s, d, "bands")
    D.write_bands(s, root)
    limits = D.band_limits_map(D.bands_table(s, root)).select("band_limits")
    used = D.scan_band_power(s, root).groupBy("run_id", "band").agg(F.count(F.lit(1)).alias("n_values"))
    listed = limits.select(F.explode("band_limits").alias("band", "l")).select("band", "l.fmin", "l.fmax")
    return used.join(listed, "band").select("run_id", "band", "fmin", "fmax", "n_values")


@query("write_bands", O.sql(
    "SELECT p.run_id, d.band, d.band_idx, d.fmax - d.fmin AS width, count(p.power) AS n_known FROM power p JOIN bands d ON d.band = p.band GROUP BY ALL",
    *ALL_POWER))
def write_bands(s, d):
    root = _stored(s, d, "bands")
    D.write_bands(s, root)
    stored = D.scan_band_power(s, root).groupBy("run_id", "band").agg(F.count("power").alias("n_known"))
    return stored.join(D.bands_table(s, root), "band").select(
        "run_id", "band", "band_idx", (F.col("fmax") - F.col("fmin")).alias("width"), "n_known")


@query("write_bipolar_electrodes", O.sql(
    "SELECT run_id, pair_idx, location FROM pairs", *O.pair_steps("elec_part")))
def write_bipolar_electrodes(s, d):
    root = scratch_path(s, "electrodes")
    electrodes = X.part_electrodes(s, d)
    D.write_bipolar_electrodes(P.bipolar_table(electrodes, P.bipolar_pairs(electrodes)), root)
    return D.read_table(s, root, "bipolar_electrodes").select("run_id", "pair_idx", "location")


@query("discover_runs", O.sql("SELECT input_path FROM found", "found"))
def discover_runs(s, d):
    return K.discover_runs(X.run_files(s, d))


# Subjects of the runs, written in both accepted forms, as many as there are nations.
SUBJECTS = "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'sub-' ELSE '' END || CAST(200 + n_nationkey AS VARCHAR) AS subject FROM nation"
SUBJECTS_TWICE = f"{SUBJECTS} UNION ALL SELECT CAST(200 + n_nationkey AS VARCHAR) AS subject FROM nation WHERE n_regionkey = 1"


def _subjects(s: SparkSession, d: str, twice: bool = False) -> DataFrame:
    nations = X.table(s, d, "nation")
    key = (F.col("n_nationkey") + 200).cast("string")
    listed = nations.select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "sub-").otherwise(""), key).alias("subject"))
    return listed.unionAll(nations.where(F.col("n_regionkey") == 1).select(key.alias("subject"))) if twice else listed


@query("normalize_subjects", O.sql(
    "SELECT s.subject, f.subject_id, count(*) AS n_files FROM s JOIN f ON f.subject_id = CASE WHEN s.subject LIKE 'sub-%' "
    "THEN replace(s.subject, 'sub-', '') ELSE s.subject END GROUP BY ALL",
    "found", ("s", SUBJECTS), ("f", "SELECT regexp_extract(input_path, '/sub-([^/]*)/', 1) AS subject_id FROM found")))
def normalize_subjects(s, d):
    files = K.discover_runs(X.run_files(s, d)).withColumn("subject_id", F.regexp_extract("input_path", "/sub-([^/]*)/", 1))
    return files.join(K.normalize_subjects(_subjects(s, d)), "subject_id").groupBy("subject", "subject_id").agg(F.count(F.lit(1)).alias("n_files"))


@query("union_subject_files", O.sql(
    "SELECT f.input_path FROM s JOIN f ON f.subject_id = replace(s.subject, 'sub-', '')",
    "found", ("s", SUBJECTS_TWICE), ("f", "SELECT input_path, regexp_extract(input_path, '/sub-([^/]*)/', 1) AS subject_id FROM found")))
def union_subject_files(s, d):
    return K.discover_runs(X.run_files(s, d), _subjects(s, d, twice=True))


@query("output_path", O.sql("SELECT path, output_path FROM files", "files"))
def output_path(s, d):
    return X.run_files(s, d).select("path", result_path(F.col("path")).alias("output_path"))


@query("pending_runs", O.sql("SELECT input_path, output_path FROM found WHERE c_custkey % 3 <> 0", "found"))
def pending_runs(s, d):
    return K.pending_runs(K.discover_runs(X.run_files(s, d)), X.run_outputs(s, d))


@query("session_metadata", (
    "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority || ' - bipolar referenced, band power computed' AS session_description, "
    "'order-' || CAST(o_orderkey AS VARCHAR) || '_bipolar_psd' AS identifier, o_orderdate AS session_start_time, "
    "CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS subject_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS sex, "
    "CASE WHEN o_orderstatus <> 'P' THEN 'Homo sapiens' END AS species, 'NihonKohden' AS device, 'sEEG_bipolar' AS group_name, "
    "'V^2/Hz' AS unit FROM orders"))
def session_metadata(s, d):
    return M.session_metadata(X.order_sessions(s, d)).select(
        "run_id", "session_description", "identifier", "session_start_time", F.col("subject.subject_id"), F.col("subject.sex"),
        F.col("subject.species"), "device", "group_name", "unit")


@query("processing_params", O.sql(
    "SELECT p.run_id, 'welch' AS method, 64::BIGINT AS nperseg, 32::BIGINT AS noverlap, 0.5::DOUBLE AS overlap_fraction, any_value(r.sfreq) AS original_sampling_rate, "
    "4.0::DOUBLE AS output_sampling_rate, max(p.bin_idx) + 1 AS n_time_bins, count(DISTINCT p.pair_idx) AS n_bipolar_pairs, 25.0::DOUBLE AS beta_high "
    "FROM power p JOIN rec r ON r.run_id = p.run_id GROUP BY p.run_id", *ALL_POWER))
def processing_params(s, d):
    layout = W.welch_layout(X.recordings(s, d), WELCH_ALL["nperseg"], WELCH_ALL["overlap"], WELCH_ALL["bin_sec"])
    params = PL.run_params(all_power(s, d), layout, "chunked", **WELCH_ALL)
    shape = ("method STRING, nperseg BIGINT, noverlap BIGINT, overlap_fraction DOUBLE, original_sampling_rate DOUBLE, "
             "output_sampling_rate DOUBLE, n_time_bins BIGINT, n_bipolar_pairs BIGINT, frequency_bands STRUCT<beta: ARRAY<DOUBLE>>")
    read = params.select("run_id", F.from_json("params", shape).alias("p"))
    return read.select("run_id", "p.*").withColumn("beta_high", F.col("frequency_bands.beta")[1]).drop("frequency_bands")


# --- projections, filters ---------------------------------------------------------------------------


@query("parse_electrode_label", O.sql("SELECT run_id, electrode_id, location, shaft, contact_num FROM parsed", "elec_part", O.parsed("elec_part")))
def parse_electrode_label(s, d):
    return E.parse_electrode_label(X.part_electrodes(s, d)).select("run_id", "electrode_id", "location", "shaft", "contact_num")


@query("drop_unparseable", O.sql("SELECT run_id, electrode_id, shaft, contact_num FROM parsed WHERE shaft IS NOT NULL", "elec_part", O.parsed("elec_part")))
def drop_unparseable(s, d):
    return E.drop_unparseable(E.parse_electrode_label(X.part_electrodes(s, d))).select("run_id", "electrode_id", "shaft", "contact_num")


@query("unparseable_report", O.sql("SELECT run_id, electrode_id, location FROM parsed WHERE shaft IS NULL", "elec_part", O.parsed("elec_part")))
def unparseable_report(s, d):
    return E.unparseable(E.parse_electrode_label(X.part_electrodes(s, d))).select("run_id", "electrode_id", "location")


OUT_OF_BRAIN = " OR ".join(f"coalesce(lower({c}) LIKE '%out of brain%', FALSE)" for c in ("location", "FS_label", "Desikan_Killiany", "JP_label_original"))


@query("out_of_brain_filter", O.sql(f"SELECT run_id, electrode_id, location FROM elec_part WHERE NOT ({OUT_OF_BRAIN})", "elec_part"))
def out_of_brain_filter(s, d):
    return E.out_of_brain_filter(X.part_electrodes(s, d)).select("run_id", "electrode_id", "location")


@query("out_of_brain_report", O.sql(f"SELECT run_id, electrode_id, location FROM elec_part WHERE {OUT_OF_BRAIN}", "elec_part"))
def out_of_brain_report(s, d):
    return E.out_of_brain_filter(X.part_electrodes(s, d), keep_excluded=True).select("run_id", "electrode_id", "location")


@query("exclude_label_filter", O.sql("SELECT run_id, electrode_id, std_label_keller FROM elec_part WHERE std_label_keller IS DISTINCT FROM 'EXCLUDE'", "elec_part"))
def exclude_label_filter(s, d):
    return E.exclude_label_filter(X.part_electrodes(s, d)).select("run_id", "electrode_id", "std_label_keller")


EXCLUDED = (
    "SELECT e.run_id, m.channel_pos, e.electrode_id, e.location, row_number() OVER (PARTITION BY e.run_id ORDER BY m.channel_pos) AS rank "
    "FROM elec_part e JOIN cmap_part m ON m.run_id = e.run_id AND m.electrode_id = e.electrode_id WHERE e.JP_label_original = 'Out of Brain'"
)


@query("excluded_channels", O.sql(f"SELECT run_id, channel_pos, electrode_id, location, CAST(rank AS INTEGER) AS rank FROM ({EXCLUDED}) WHERE rank <= 20", "elec_part", "cmap_part"))
def excluded_channels(s, d):
    return E.excluded_channels(X.part_electrodes(s, d), X.part_channel_map(s, d))


@query("excluded_channel_lookup", O.sql(
    "SELECT e.run_id, e.electrode_id, e.location, m.channel_pos FROM elec_part e JOIN cmap_part m ON m.run_id = e.run_id AND m.electrode_id = e.electrode_id "
    "WHERE e.JP_label_original = 'Out of Brain' AND m.channel_pos < 40", "elec_part", "cmap_part"))
def excluded_channel_lookup(s, d):
    marked = X.part_electrodes(s, d).where(F.col("JP_label_original") == "Out of Brain")
    recorded = C.first_n_channels(X.part_channel_map(s, d), 40)
    return E.excluded_channel_lookup(marked, recorded)


def _segment_sql(start: str) -> str:
    length = f"least({MIN_LEN.format(m=0.005)}, n_samples)"
    return (f"SELECT s.run_id, s.channel_pos, s.sample_idx, s.value FROM sig s JOIN (SELECT run_id, {start} AS lo, {length} AS len FROM rec) r "
            "ON r.run_id = s.run_id AND s.sample_idx >= r.lo AND s.sample_idx < r.lo + r.len")


def _segment(s, d, segment):
    part = C.segment_select(X.signals(s, d), X.recordings(s, d), 0.005, segment)
    return B.sample_rows(part).select("run_id", "channel_pos", "sample_idx", "value")


LENGTH = f"least({MIN_LEN.format(m=0.005)}, n_samples)"


@query("segment_select", O.sql(_segment_sql(f"(n_samples - {LENGTH}) // 2"), "sig", "rec"))
def segment_select(s, d):
    return _segment(s, d, "middle")


@query("segment_select_start", O.sql(_segment_sql("0"), "sig", "rec"))
def segment_select_start(s, d):
    return _segment(s, d, "start")


@query("segment_select_end", O.sql(_segment_sql(f"n_samples - {LENGTH}"), "sig", "rec"))
def segment_select_end(s, d):
    return _segment(s, d, "end")


@query("first_n_channels", O.sql("SELECT run_id, channel_pos, sample_idx, value FROM sig WHERE channel_pos < 20", "sig"))
def first_n_channels(s, d):
    return B.sample_rows(C.first_n_channels(X.signals(s, d), 20)).select("run_id", "channel_pos", "sample_idx", "value")


@query("channels_by_index", O.sql(
    "SELECT run_id, pair_idx, location, sample_idx, round(value, 9) + 0.0 AS value FROM bip WHERE pair_idx IN (0, 10, 50, 100, 150)", *O.bipolar_steps("all")))
def channels_by_index(s, d):
    chosen = C.channels_by_index(P.bipolar_pairs(X.electrodes(s, d)))
    bipolar = bipolar_subtract(X.signals(s, d), X.channel_map(s, d), chosen)
    return B.sample_rows(bipolar).select("run_id", "pair_idx", "location", "sample_idx", R("value").alias("value"))


@query("channels_by_name", O.sql(
    "SELECT run_id, pair_idx, location FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pair_idx) AS r FROM pairs WHERE location LIKE '%LANT%') WHERE r <= 5",
    *O.pair_steps("elec_part")))
def channels_by_name(s, d):
    return C.channels_by_name(P.bipolar_pairs(X.part_electrodes(s, d)), "LANT")


SHAFT_TRACES = (
    "traces",
    "SELECT 'raw' AS kind, s.run_id, s.channel_pos AS trace_idx, p.location, s.sample_idx, s.value FROM sig_emb s JOIN cmap_emb m "
    "ON m.run_id = s.run_id AND m.channel_pos = s.channel_pos JOIN parsed p ON p.run_id = m.run_id AND p.electrode_id = m.electrode_id WHERE p.shaft = 'LANT' "
    "UNION ALL SELECT 'bipolar' AS kind, b.run_id, b.pair_idx AS trace_idx, b.location, b.sample_idx, b.value FROM bip b JOIN pairs p "
    "ON p.run_id = b.run_id AND p.pair_idx = b.pair_idx WHERE p.shaft = 'LANT'",
)


def _shaft(s, d):
    electrodes, channels = X.emb_electrodes(s, d), X.emb_channel_map(s, d)
    placed = E.channel_electrode_join(channels, E.parse_electrode_label(electrodes))
    pairs = P.bipolar_pairs(electrodes)
    signals = X.emb_signals(s, d)
    return C.shaft_select(signals, bipolar_subtract(signals, channels, pairs), placed, pairs, "LANT")


@query("shaft_select", O.sql("SELECT kind, run_id, trace_idx, location, sample_idx, round(value, 9) + 0.0 AS value FROM traces", *O.bipolar_steps("emb"), SHAFT_TRACES))
def shaft_select(s, d):
    return B.sample_rows(_shaft(s, d)).select("kind", "run_id", "trace_idx", "location", "sample_idx", R("value").alias("value"))


@query("sample_time", O.sql(
    "SELECT s.run_id, s.channel_pos, s.sample_idx, round(s.sample_idx / r.sfreq / 60, 10) AS time_min FROM sig s JOIN rec r ON r.run_id = s.run_id", "sig", "rec"))
def sample_time(s, d):
    rows = B.sample_rows(X.signals(s, d)).join(X.recordings(s, d).select("run_id", "sfreq"), "run_id")
    return rows.select("run_id", "channel_pos", "sample_idx", R(sample_minutes(F.col("sample_idx"), F.col("sfreq")), 10).alias("time_min"))


@query("to_microvolt", O.sql("SELECT run_id, channel_pos, sample_idx, round(value * 1e6, 6) + 0.0 AS microvolt FROM sig", "sig"))
def to_microvolt_query(s, d):
    return B.sample_rows(X.signals(s, d)).select("run_id", "channel_pos", "sample_idx", R(to_microvolt(F.col("value")), 6).alias("microvolt"))


@query("window_axis_from_rate", O.sql(
    "SELECT DISTINCT p.run_id, p.bin_idx, round(p.bin_idx / 4.0, 9) AS time_sec, round(p.bin_idx / 4.0 / 60, 9) AS time_min, "
    "round((max(p.bin_idx) OVER (PARTITION BY p.run_id) + 1) / 4.0, 9) AS duration_sec, 0.25::DOUBLE AS step_sec FROM power p", *ALL_POWER))
def window_axis_from_rate(s, d):
    rates = X.recordings(s, d).select("run_id", F.lit(4.0).alias("rate"))
    axis = RP.window_axis_from_rate(all_power(s, d), rates)
    return axis.select("run_id", "bin_idx", *[R(c).alias(c) for c in ("time_sec", "time_min", "duration_sec", "step_sec")])


@query("trace_layout", O.sql(
    "SELECT run_id, channel_pos, channel_pos AS rank, round(channel_pos * 4 * stddev_pop(value) OVER (PARTITION BY run_id), 9) + 0.0 AS offset_value "
    "FROM sig QUALIFY row_number() OVER (PARTITION BY run_id, channel_pos ORDER BY sample_idx) = 1", "sig"))
def trace_layout(s, d):
    return Q.trace_layout(X.signals(s, d)).select("run_id", "channel_pos", "rank", R("offset").alias("offset_value"))


@query("pair_label", O.sql("SELECT run_id, anode_location, cathode_location, anode_location || '-' || cathode_location AS label FROM pairs", *O.pair_steps("elec_part")))
def pair_label_query(s, d):
    pairs = P.bipolar_pairs(X.part_electrodes(s, d))
    return pairs.select("run_id", "anode_location", "cathode_location", pair_label(F.col("anode_location"), F.col("cathode_location")).alias("label"))


# --- joins -------------------------------------------------------------------------------------------


@query("channel_electrode_join", O.sql(
    "SELECT m.run_id, m.channel_pos, m.electrode_id, e.location, e.vendor_name FROM cmap_part m JOIN elec_part e ON e.run_id = m.run_id AND e.electrode_id = m.electrode_id",
    "cmap_part", "elec_part"))
def channel_electrode_join(s, d):
    return E.channel_electrode_join(X.part_channel_map(s, d), X.part_electrodes(s, d)).select("run_id", "channel_pos", "electrode_id", "location", "vendor_name")


@query("bipolar_subtract", O.sql("SELECT run_id, pair_idx, location, sample_idx, round(value, 9) + 0.0 AS value FROM bip", *O.bipolar_steps("all")))
def bipolar_subtract_query(s, d):
    return B.sample_rows(all_bipolar(s, d)).select("run_id", "pair_idx", "location", "sample_idx", R("value").alias("value"))


SINGLE = ["group_name"]
AVERAGED = ["MNI_coord_1", "MNI_coord_2", "LEPTO_coord_1"]
OTHERS = ["FS_label", "Desikan_Killiany", "JP_label_original", "std_label_keller", "vendor_name"]
TABLE_FROM = (
    " FROM pairs p JOIN parsed a ON a.run_id = p.run_id AND a.electrode_id = p.anode_id "
    "JOIN parsed c ON c.run_id = p.run_id AND c.electrode_id = p.cathode_id"
)


def _both(columns):
    return ", ".join(f"a.{c} AS {c}_anode, c.{c} AS {c}_cathode" for c in columns)


@query("bipolar_table_averaged", O.sql(
    'SELECT p.run_id, p.pair_idx, p.location, a."group" AS "group", a.group_name, '
    + ", ".join(f"round(coalesce((a.{c} + c.{c}) / 2, a.{c}, c.{c}), 6) + 0.0 AS {c}" for c in AVERAGED)
    + ", " + _both(OTHERS) + TABLE_FROM, *O.pair_steps("elec_part")))
def bipolar_table_averaged(s, d):
    electrodes = X.part_electrodes(s, d)
    table = P.bipolar_table(electrodes, P.bipolar_pairs(electrodes), "averaged")
    return table.withColumns({c: R(c, 6) for c in AVERAGED})


@query("bipolar_table_suffixed", O.sql(
    'SELECT p.run_id, p.pair_idx, p.location, a."group" AS "group", a.group_name, '
    + _both(AVERAGED + OTHERS + ["shaft", "contact_num"]) + TABLE_FROM, *O.pair_steps("elec_part")))
def bipolar_table_suffixed(s, d):
    electrodes = E.drop_unparseable(E.parse_electrode_label(X.part_electrodes(s, d)))
    return P.bipolar_table(electrodes, P.bipolar_pairs(electrodes), "suffixed")


HOP_DENSITY = [*O.bipolar_steps("all"), "bands", *O.hop_groups("50", "25"), *O.spectrum_steps()]


def hop_density(s, d):
    return W.spectrogram(W.relayout(all_bipolar(s, d), W.hop_layout(X.recordings(s, d), **HOP_ALL)))


@query("band_range_join", O.sql(
    "SELECT p.run_id, p.pair_idx, p.bin_idx AS window_idx, p.k AS freq_idx, d.band, round(p.psd, 10) + 0.0 AS psd FROM psd p JOIN bands d ON p.freq >= d.fmin AND p.freq < d.fmax",
    *HOP_DENSITY))
def band_range_join(s, d):
    return W.band_range_join(hop_density(s, d), bands_frame(s)).select("run_id", "pair_idx", "window_idx", "freq_idx", "band", R("psd", 10).alias("psd"))


# --- aggregations -------------------------------------------------------------------------------------


@query("band_mean", O.sql(
    "SELECT run_id, pair_idx, bin_idx AS window_idx, band, round(power, 10) + 0.0 AS power FROM power", *HOP_DENSITY, O.BAND_POWER))
def band_mean(s, d):
    means = W.band_mean(hop_density(s, d), ["run_id", "pair_idx", "window_idx"])
    return means.select("run_id", "pair_idx", "window_idx", "band", R("power", 10).alias("power"))


WELCH_EMB = [*O.bipolar_steps("emb"), "bands", *O.welch_groups(**WELCH), *O.spectrum_steps()]


@query("welch_average", O.sql(
    "SELECT g.run_id, g.pair_idx, g.bin_idx, round(g.time_sec, 9) AS time_sec, p.k AS freq_idx, round(p.freq, 6) AS freq, round(avg(p.psd), 10) + 0.0 AS psd "
    "FROM grp_t g JOIN psd p ON p.run_id = g.run_id AND p.pair_idx = g.pair_idx AND p.bin_idx = g.bin_idx GROUP BY ALL", *WELCH_EMB))
def welch_average(s, d):
    laid = W.relayout(emb_bipolar(s, d), W.welch_layout(X.emb_recordings(s, d), WELCH["nperseg"], WELCH["overlap"], WELCH["bin_sec"]))
    return W.welch_average(laid, WELCH["max_freq"]).select(
        "run_id", "pair_idx", "bin_idx", R("time_sec").alias("time_sec"), "freq_idx", R("freq", 6).alias("freq"), R("psd", 10).alias("psd"))


STATS = "count(*) AS n, round(min(value), 9) + 0.0 AS min, round(max(value), 9) + 0.0 AS max, round(avg(value), 9) + 0.0 AS mean, round(stddev_pop(value), 9) AS std, round(max(value) - min(value), 9) AS range"


@query("signal_stats", O.sql(
    f"SELECT 'V' AS unit, kind, run_id, {STATS} FROM traces GROUP BY ALL UNION ALL "
    f"SELECT 'uV' AS unit, kind, run_id, {STATS.replace('value', 'value * 1e6').replace(', 9)', ', 3)')} FROM traces GROUP BY ALL",
    *O.bipolar_steps("emb"), SHAFT_TRACES))
def signal_stats(s, d):
    shaft = _shaft(s, d)
    names = ("min", "max", "mean", "std", "range")

    def unit(name, scale, digits):
        stats = Q.signal_stats(shaft, ["kind", "run_id"], scale)
        return stats.select(F.lit(name).alias("unit"), "kind", "run_id", "n", *[R(c, digits).alias(c) for c in names])

    return unit("V", 1.0, 9).unionByName(unit("uV", 1e6, 3))


@query("channel_std", O.sql(
    "SELECT kind, run_id, trace_idx, location, round(stddev_pop(value * 1e6), 3) AS std FROM traces GROUP BY ALL", *O.bipolar_steps("emb"), SHAFT_TRACES))
def channel_std(s, d):
    stds = Q.channel_std(_shaft(s, d), ["kind", "run_id", "trace_idx", "location"])
    return stds.withColumn("std", R("std", 3))


RATIO_SIDES = (
    "sides",
    "SELECT kind, run_id, trace_idx, value, stddev_pop(value) OVER (PARTITION BY kind, run_id) AS std, "
    "dense_rank() OVER (PARTITION BY kind, run_id ORDER BY trace_idx) - 1 AS rank FROM traces",
)
RATIO_STATS = (
    "stats",
    "SELECT kind, run_id, any_value(std) AS std, max(value) - min(value) AS rng, min(value + rank * 4 * std) AS lo, max(value + rank * 4 * std) AS hi FROM sides GROUP BY ALL",
)


@query("raw_vs_bipolar_ratio", O.sql(
    "SELECT r.run_id, round(b.std / r.std, 9) AS std_ratio, round(b.rng / r.rng, 9) AS range_ratio, round(greatest(r.rng, b.rng), 9) AS max_range, "
    "round(least(r.lo, b.lo), 9) AS axis_low, round(greatest(r.hi, b.hi), 9) AS axis_high FROM stats r JOIN stats b ON b.run_id = r.run_id "
    "WHERE r.kind = 'raw' AND b.kind = 'bipolar'",
    *O.bipolar_steps("all"),
    ("traces", "SELECT 'raw' AS kind, run_id, channel_pos AS trace_idx, sample_idx, value FROM sig UNION ALL SELECT 'bipolar', run_id, pair_idx, sample_idx, value FROM bip"),
    RATIO_SIDES, RATIO_STATS))
def raw_vs_bipolar_ratio(s, d):
    ratios = Q.raw_vs_bipolar_ratio(X.signals(s, d), all_bipolar(s, d))
    return ratios.select("run_id", *[R(c).alias(c) for c in ("std_ratio", "range_ratio", "max_range", "axis_low", "axis_high")])


BAND_STATS = ", ".join(f"round({f}(power), 10) + 0.0 AS {n}" for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max")))


def _rounded_stats(stats):
    return stats.select("run_id", "band", *[R(c, 10).alias(c) for c in ("mean", "std", "min", "max")])


@query("band_stats", O.sql(f"SELECT run_id, band, {BAND_STATS} FROM power GROUP BY ALL", *ALL_POWER))
def band_stats(s, d):
    return _rounded_stats(Q.band_stats(all_power(s, d)))


FLAGS = (
    "bool_or(power IS NULL OR isnan(power)) AS has_nan, bool_or(coalesce(isinf(power), FALSE)) AS has_inf, "
    "bool_and(coalesce(abs(power) <= {tol} AND NOT isnan(power), FALSE)) AS all_zero"
)

# The signal with one NaN and one infinity, and the flags of its own samples taken as powers.
SPOILED = (
    "power",
    "SELECT run_id, channel_pos AS pair_idx, sample_idx AS bin_idx, CASE WHEN run_id = 'emb' AND channel_pos = 3 AND sample_idx = 7 THEN 'nan'::DOUBLE "
    "WHEN run_id = 'ev-0' AND channel_pos = 2 AND sample_idx = 5 THEN 'inf'::DOUBLE ELSE value END AS power FROM sig",
)


@query("quality_flags", O.sql("SELECT run_id, " + FLAGS.format(tol="1e-8") + " FROM power GROUP BY run_id", "sig", SPOILED))
def quality_flags(s, d):
    at = lambda run, channel, sample: (F.col("run_id") == run) & (F.col("channel_pos") == channel) & (F.col("sample_idx") == sample)
    rows = B.sample_rows(X.signals(s, d)).withColumn(
        "power", F.when(at("emb", 3, 7), F.lit(float("nan"))).when(at("ev-0", 2, 5), F.lit(float("inf"))).otherwise(F.col("value")))
    return Q.quality_flags(rows)


def _std_windows(seconds: float, source: str = "bip") -> tuple[str, str]:
    return (
        "windows",
        f"SELECT b.run_id, b.pair_idx, b.location, b.sample_idx // CAST(floor({seconds} * r.sfreq) AS BIGINT) AS window_idx, "
        f"any_value(r.sfreq) AS sfreq, any_value(CAST(floor({seconds} * r.sfreq) AS BIGINT)) AS len, stddev_pop(b.value) AS std "
        f"FROM {source} b JOIN rec r ON r.run_id = b.run_id GROUP BY ALL HAVING count(*) = any_value(CAST(floor({seconds} * r.sfreq) AS BIGINT))",
    )


DROP_STEPS = O.bipolar_steps("emb", sig="sig_drop")


@query("window_std", O.sql(
    "SELECT run_id, pair_idx, location, window_idx, round((window_idx + 0.5) * len / sfreq / 60, 9) AS time_min, round(std, 9) + 0.0 AS std FROM windows",
    *O.bipolar_steps("all"), _std_windows(WINDOW_SEC)))
def window_std(s, d):
    return Q.window_std(all_bipolar(s, d), X.recordings(s, d), WINDOW_SEC).drop("series_name").withColumns({"time_min": R("time_min"), "std": R("std")})


DROPOUTS = (
    "drops",
    "SELECT w.*, m.med FROM windows w JOIN (SELECT run_id, pair_idx, median(std) AS med FROM windows GROUP BY ALL) m "
    "ON m.run_id = w.run_id AND m.pair_idx = w.pair_idx WHERE w.std < 0.9 * m.med",
)
# On this test signal a silent channel still leaves its neighbour's noise, so the ratio is 0.9 and not 0.1.
DROP_RATIO = 0.9


@query("dropout_detect", O.sql(
    "SELECT run_id, pair_idx, location, window_idx, round((window_idx + 0.5) * len / sfreq / 60, 9) AS time_min, round(std, 9) + 0.0 AS std, round(med, 9) AS median, "
    f"round((window_idx + 0.5) * len / sfreq / 60 - {WINDOW_SEC} / 120, 9) + 0.0 AS span_start_min, round((window_idx + 0.5) * len / sfreq / 60 + {WINDOW_SEC} / 120, 9) AS span_end_min FROM drops",
    *DROP_STEPS, _std_windows(WINDOW_SEC), DROPOUTS))
def dropout_detect(s, d):
    found = Q.dropout_detect(drop_bipolar(s, d), X.emb_recordings(s, d), WINDOW_SEC, DROP_RATIO).drop("series_name")
    return found.withColumns({c: R(c) for c in ("time_min", "std", "median", "span_start_min", "span_end_min")})


@query("segment_flatness", O.sql(
    "SELECT run_id, window_idx AS segment_idx, round(window_idx * any_value(len) / any_value(sfreq) / 60, 9) AS start_min, round((window_idx + 1) * any_value(len) / any_value(sfreq) / 60, 9) AS end_min, "
    "round(avg(std), 9) + 0.0 AS mean_std, count(*) FILTER (std < 1e-10) AS zero_channels, count(*) AS n_channels FROM windows GROUP BY run_id, window_idx",
    *DROP_STEPS,
    ("chan", "SELECT run_id, channel_pos AS pair_idx, CAST(channel_pos AS VARCHAR) AS location, sample_idx, value FROM sig_drop"),
    _std_windows(SEGMENT_SEC, "chan")))
def segment_flatness(s, d):
    channels = X.drop_signals(s, d).withColumnRenamed("channel_pos", "pair_idx")
    flat = Q.segment_flatness(channels, X.emb_recordings(s, d), SEGMENT_SEC).drop("series_name")
    return flat.withColumns({c: R(c) for c in ("start_min", "end_min", "mean_std")})


@query("electrode_counts", O.sql(
    f"SELECT f.run_id, count(*) AS n_electrodes, count(*) FILTER (oob) AS n_excluded, count(*) FILTER (NOT oob AND shaft IS NULL) AS n_unparseable, "
    "count(*) FILTER (NOT oob AND shaft IS NOT NULL) AS n_usable, count(DISTINCT shaft) FILTER (NOT oob) AS n_shafts, any_value(coalesce(p.n, 0)) AS n_pairs "
    "FROM flagged f LEFT JOIN (SELECT run_id, count(*) AS n FROM pairs GROUP BY run_id) p ON p.run_id = f.run_id GROUP BY f.run_id",
    "elec_part",
    ("flagged", f"SELECT *, {OUT_OF_BRAIN} AS oob, NULLIF(regexp_extract(location, '{O.PATTERN}', 1), '') AS shaft FROM elec_part"),
    ("kept", "SELECT run_id, electrode_id, location FROM flagged WHERE NOT oob"), O.parsed("kept"), O.NEIGHBOURS, O.PAIRS))
def electrode_counts(s, d):
    electrodes = X.part_electrodes(s, d)
    return E.electrode_counts(electrodes, P.bipolar_pairs(E.out_of_brain_filter(electrodes)))


@query("run_status_summary", O.sql(
    "SELECT count(*) AS processed, count(*) FILTER (c_custkey % 13 <> 0) AS succeeded, count(*) FILTER (c_custkey % 13 = 0) AS failed, "
    "count(*) FILTER (c_custkey % 13 = 0) = 0 AS all_ok FROM files", "files"))
def run_status_summary(s, d):
    return M.run_status_summary(X.run_status(s, d))


@query("run_status_failed", O.sql("SELECT path AS run_id, 'failed' AS status FROM files WHERE c_custkey % 13 = 0", "files"))
def run_status_failed(s, d):
    return M.failed_runs(X.run_status(s, d))


# --- windows -------------------------------------------------------------------------------------------


@query("bipolar_pairs", O.sql("SELECT run_id, pair_idx, shaft, anode_id, cathode_id, location FROM pairs", *O.pair_steps("elec_part")))
def bipolar_pairs(s, d):
    return P.bipolar_pairs(X.part_electrodes(s, d)).select("run_id", "pair_idx", "shaft", "anode_id", "cathode_id", "location")


@query("skipped_pairs", O.sql(
    "SELECT run_id, shaft, electrode_id AS anode_id, next_id AS cathode_id, location || '-' || next_location AS location FROM neighbours WHERE next_num - contact_num <> 1",
    *O.pair_steps("elec_part")))
def skipped_pairs(s, d):
    return P.skipped_pairs(X.part_electrodes(s, d))


def _hop_rows(s, d):
    laid = W.relayout(emb_bipolar(s, d), W.hop_layout(X.emb_recordings(s, d), **HOP))
    return W.hop_segments(laid)


HOP_SEGMENTS = [*O.bipolar_steps("emb"), *O.hop_groups("200", "100")]


@query("hop_segments", O.sql(
    "SELECT s.run_id, s.pair_idx, s.w AS window_idx, b.sample_idx, round(b.value, 9) + 0.0 AS value FROM seg s JOIN bip b ON b.run_id = s.run_id AND b.pair_idx = s.pair_idx "
    "AND b.sample_idx >= s.seg_start AND b.sample_idx < s.seg_start + s.n_eff", *HOP_SEGMENTS))
def hop_segments(s, d):
    return B.sample_rows(_hop_rows(s, d)).select("run_id", "pair_idx", "window_idx", "sample_idx", R("value").alias("value"))


@query("segment_detrend", O.sql(
    "SELECT s.run_id, s.pair_idx, s.w AS window_idx, b.sample_idx, round(b.value - avg(b.value) OVER (PARTITION BY s.run_id, s.pair_idx, s.w), 9) + 0.0 AS value "
    "FROM seg s JOIN bip b ON b.run_id = s.run_id AND b.pair_idx = s.pair_idx AND b.sample_idx >= s.seg_start AND b.sample_idx < s.seg_start + s.n_eff", *HOP_SEGMENTS))
def segment_detrend(s, d):
    return B.sample_rows(W.segment_detrend(_hop_rows(s, d))).select("run_id", "pair_idx", "window_idx", "sample_idx", R("value").alias("value"))


@query("window_center_time", O.sql("SELECT run_id, pair_idx, w AS window_idx, round(time_sec, 9) AS time_sec FROM seg", *HOP_SEGMENTS))
def window_center_time(s, d):
    return W.window_center_time(_hop_rows(s, d)).select("run_id", "pair_idx", "window_idx", R("time_sec").alias("time_sec"))


@query("time_bins", O.sql(
    "SELECT s.run_id, s.channel_pos, s.sample_idx // CAST(floor(0.25 * r.sfreq) AS BIGINT) AS bin_idx, min(s.sample_idx) AS start_sample, CAST(count(*) AS INTEGER) AS n_samples, "
    "round(sum(s.value), 9) + 0.0 AS total FROM sig s JOIN rec r ON r.run_id = s.run_id GROUP BY ALL", "sig", "rec"))
def time_bins(s, d):
    bins = W.time_bins(X.signals(s, d), X.recordings(s, d), 0.25)
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return bins.select("run_id", "channel_pos", "bin_idx", "start_sample", F.size("samples").alias("n_samples"), R(total).alias("total"))


@query("output_rate", O.sql(
    "SELECT run_id, round(coalesce(1 / (max(time_sec) FILTER (bin_idx = 1) - max(time_sec) FILTER (bin_idx = 0)), 4.0), 9) AS rate FROM power GROUP BY run_id", *ALL_POWER))
def output_rate(s, d):
    return Q.output_rate(all_power(s, d), WELCH_ALL["bin_sec"]).withColumn("rate", R("rate"))


TAIL = ("tail", "SELECT * FROM (SELECT *, max(bin_idx) OVER (PARTITION BY run_id) + 1 AS n_bins FROM power) WHERE bin_idx >= n_bins // 3")


@query("tail_windows", O.sql("SELECT run_id, bin_idx, pair_idx, band, round(power, 10) + 0.0 AS power FROM tail", *ALL_POWER, TAIL))
def tail_windows(s, d):
    return Q.tail_windows(all_power(s, d)).select("run_id", "bin_idx", "pair_idx", "band", R("power", 10).alias("power"))


# --- spectra -------------------------------------------------------------------------------------------


@query("periodogram", O.sql(
    "SELECT s.run_id, s.pair_idx, s.w AS window_idx, p.k AS freq_idx, round(p.freq, 6) AS freq, round(p.psd, 10) + 0.0 AS psd FROM seg s JOIN psd p "
    "ON p.run_id = s.run_id AND p.pair_idx = s.pair_idx AND p.bin_idx = s.bin_idx", *HOP_SEGMENTS, *O.spectrum_steps()))
def periodogram(s, d):
    return W.periodogram(_hop_rows(s, d)).select("run_id", "pair_idx", "window_idx", "freq_idx", R("freq", 6).alias("freq"), R("psd", 10).alias("psd"))


@query("spectrogram", O.sql(
    "SELECT s.run_id, s.pair_idx, s.location, s.w AS window_idx, round(s.time_sec, 9) AS time_sec, p.k AS freq_idx, round(p.freq, 6) AS freq, round(p.psd, 10) + 0.0 AS psd "
    "FROM seg s JOIN psd p ON p.run_id = s.run_id AND p.pair_idx = s.pair_idx AND p.bin_idx = s.bin_idx", *HOP_DENSITY))
def spectrogram(s, d):
    return hop_density(s, d).select(
        "run_id", "pair_idx", "location", "window_idx", R("time_sec").alias("time_sec"), "freq_idx", R("freq", 6).alias("freq"), R("psd", 10).alias("psd"))


@query("bandpower_stft", O.sql(O.ROUNDED_POWER, *O.hop_power("all", "50", "25")))
def bandpower_stft(s, d):
    return rounded_power(BP.bandpower_stft(all_bipolar(s, d), X.recordings(s, d), **HOP_ALL))


@query("bandpower_welch_bin", O.sql(O.ROUNDED_POWER + " WHERE bin_idx = 2", *O.welch_power("emb", 200, 0.5, 0.5, 200.0)))
def bandpower_welch_bin(s, d):
    return rounded_power(BP.bandpower_welch_bin(emb_bipolar(s, d), X.emb_recordings(s, d), 2, nperseg=200, overlap=0.5, bin_sec=0.5))


@query("bandpower_welch", O.sql(O.ROUNDED_POWER, *O.welch_power("emb", **WELCH)))
def bandpower_welch(s, d):
    return rounded_power(BP.bandpower_welch(emb_bipolar(s, d), X.emb_recordings(s, d), **WELCH))


# --- sorts, limits ------------------------------------------------------------------------------------


@query("sort_contacts", O.sql(
    "SELECT run_id, shaft, electrode_id, CAST(row_number() OVER (PARTITION BY run_id, shaft ORDER BY contact_num, electrode_id) AS INTEGER) AS rank FROM parsed WHERE shaft IS NOT NULL",
    "elec_part", O.parsed("elec_part")))
def sort_contacts(s, d):
    return E.sort_contacts(E.parse_electrode_label(X.part_electrodes(s, d))).select("run_id", "shaft", "electrode_id", "rank")


@query("sort_groups", O.sql(
    "SELECT run_id, shaft, count(*) AS n_contacts, CAST(row_number() OVER (PARTITION BY run_id ORDER BY shaft) AS INTEGER) AS rank FROM parsed WHERE shaft IS NOT NULL GROUP BY run_id, shaft",
    "elec_part", O.parsed("elec_part")))
def sort_groups(s, d):
    return E.sort_groups(E.parse_electrode_label(X.part_electrodes(s, d)))


@query("sort_paths", O.sql("SELECT input_path FROM found ORDER BY input_path", "found"))
def sort_paths(s, d):
    return K.sort_paths(K.discover_runs(X.run_files(s, d)))


@query("preview_limit", O.sql(
    "SELECT input_path, greatest((SELECT count(*) FROM found) - 3, 0) AS n_more FROM found ORDER BY input_path LIMIT 3", "found"))
def preview_limit(s, d):
    return K.preview(K.discover_runs(X.run_files(s, d)))


# --- whole processing ------------------------------------------------------------------------------------------


def _process(s, d, preset, **overrides):
    return PL.process(X.signals(s, d), X.recordings(s, d), X.electrodes(s, d), X.channel_map(s, d), preset, **overrides)


@query("process_welch", O.sql(O.ROUNDED_POWER, *ALL_POWER))
def process_welch(s, d):
    return rounded_power(_process(s, d, "chunked", **WELCH_ALL)["band_power"])


@query("process_pending", O.sql(
    "SELECT run_id, 'succeeded' AS status, CASE WHEN run_id = 'emb' THEN 2 ELSE 1 END AS attempts, count(*) AS n_values FROM power GROUP BY run_id "
    "UNION ALL SELECT 'lost', 'failed', 0, 0", *ALL_POWER))
def process_pending(s, d):
    """Two calls: in the first the long recording has no electrodes and fails, in the second only it is processed."""
    root = scratch_path(s, "pending")
    runs = X.recordings(s, d).select("run_id").unionByName(s.range(1).select(F.lit("lost").alias("run_id")))
    for electrodes in (X.electrodes(s, d).where("run_id <> 'emb'"), X.electrodes(s, d)):
        status = PL.process_pending(runs, X.signals(s, d), X.recordings(s, d), electrodes, X.channel_map(s, d), root, "chunked", **WELCH_ALL)
    attempts = D.read_ledger(s, root).groupBy("run_id").agg(F.count("*").alias("attempts"))
    values = D.scan_band_power(s, root).groupBy("run_id").agg(F.count("*").alias("n_values"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    counted = status.join(attempts, "run_id", "left").join(values, "run_id", "left")
    return counted.select("run_id", "status", zero("attempts").cast("int").alias("attempts"), zero("n_values").alias("n_values"))


@query("process_stft", O.sql(O.ROUNDED_POWER, *O.hop_power("all", "40", "30")))
def process_stft(s, d):
    return rounded_power(_process(s, d, "whole_file", nperseg=40, overlap=0.75)["band_power"])


IN_BRAIN = ("elec_in", "SELECT run_id, electrode_id, location FROM elec_emb WHERE NOT (" + " OR ".join(
    f"coalesce(lower({c}) LIKE '%out of brain%', FALSE)" for c in ("location", "FS_label", "JP_label_original")) + ") UNION ALL SELECT run_id, electrode_id, location FROM elec_ev")


@query("process_stft_in_brain", O.sql(
    O.ROUNDED_POWER, *O.hop_power("all", "floor(0.1 * sfreq)", "floor(0.05 * sfreq)", elec="elec_in", extra=["elec_emb", "elec_ev", IN_BRAIN])))
def process_stft_in_brain(s, d):
    return rounded_power(_process(s, d, "in_brain", window_sec=0.1, overlap_sec=0.05)["band_power"])


@query("bandpower_report", O.sql(
    "SELECT p.run_id, p.pair_idx, p.location, p.band, d.fmin, d.fmax, p.bin_idx, round(p.time_sec, 9) AS time_sec, round(p.bin_idx / 4.0, 9) AS axis_sec, "
    "round(p.bin_idx / 4.0 / 60, 9) AS axis_min, round(p.power, 10) + 0.0 AS power FROM power p JOIN bands d ON d.band = p.band", *ALL_POWER))
def bandpower_report(s, d):
    rates = X.recordings(s, d).select("run_id", F.lit(4.0).alias("rate"))
    report = RP.bandpower_report(all_power(s, d), bands_frame(s).drop("band_idx"), rates)
    return report.withColumns({"time_sec": R("time_sec"), "axis_sec": R("axis_sec"), "axis_min": R("axis_min"), "power": R("power", 10)})


@query("bipolar_qc", O.sql(
    "SELECT run_id, pair_idx, location, count(*) AS n_dropouts FROM drops GROUP BY ALL", *DROP_STEPS, _std_windows(WINDOW_SEC), DROPOUTS))
def bipolar_qc(s, d):
    return RP.bipolar_qc(drop_bipolar(s, d), X.emb_recordings(s, d), WINDOW_SEC, SEGMENT_SEC, DROP_RATIO)["dropout_counts"].drop("series_name")


@query("bandpower_qc", O.sql(
    "SELECT f.*, s.band, s.mean, s.std, s.min, s.max FROM (SELECT run_id, " + FLAGS.format(tol="1e-8") + " FROM tail GROUP BY run_id) f "
    f"JOIN (SELECT run_id, band, {BAND_STATS} FROM tail GROUP BY ALL) s ON s.run_id = f.run_id", *ALL_POWER, TAIL))
def bandpower_qc(s, d):
    checks = RP.bandpower_qc(D.scan_band_power(s, _stored(s, d, "qc")))
    return checks["tail_flags"].join(_rounded_stats(checks["tail_stats"]), "run_id")


# --- series of one run, samples that are absent or stored twice --------------------------------------


@query("segment_select_by_series", O.sql(
    "SELECT s.run_id, s.series_name, s.channel_pos, s.sample_idx, s.value FROM sig_two s JOIN (SELECT run_id, series_name, "
    f"(n_samples - {LENGTH}) // 2 AS lo, {LENGTH} AS len FROM rec_two) r ON r.run_id = s.run_id AND r.series_name = s.series_name "
    "AND s.sample_idx >= r.lo AND s.sample_idx < r.lo + r.len", "rec_two"))
def segment_select_by_series(s, d):
    part = C.segment_select(X.two_series(s, d), X.two_recordings(s, d), 0.005, "middle")
    return B.sample_rows(part).select("run_id", "series_name", "channel_pos", "sample_idx", "value")


SERIES_WINDOWS = (
    "windows",
    f"SELECT s.run_id, s.series_name, s.channel_pos AS pair_idx, CAST(s.channel_pos AS VARCHAR) AS location, s.sample_idx // CAST(floor({WINDOW_SEC} * r.sfreq) AS BIGINT) AS window_idx, "
    f"any_value(r.sfreq) AS sfreq, any_value(CAST(floor({WINDOW_SEC} * r.sfreq) AS BIGINT)) AS len, stddev_pop(s.value) AS std FROM sig_two s "
    "JOIN rec_two r ON r.run_id = s.run_id AND r.series_name = s.series_name GROUP BY ALL "
    f"HAVING count(*) = any_value(CAST(floor({WINDOW_SEC} * r.sfreq) AS BIGINT))",
)


def _channels_of_series(s, d):
    return X.two_series(s, d).withColumn("location", F.col("channel_pos").cast("string")).withColumnRenamed("channel_pos", "pair_idx")


@query("window_std_by_series", O.sql(
    "SELECT run_id, series_name, pair_idx, location, window_idx, round((window_idx + 0.5) * len / sfreq / 60, 9) AS time_min, round(std, 9) + 0.0 AS std FROM windows",
    "rec_two", SERIES_WINDOWS))
def window_std_by_series(s, d):
    return Q.window_std(_channels_of_series(s, d), X.two_recordings(s, d), WINDOW_SEC).withColumns({"time_min": R("time_min"), "std": R("std")})


@query("dropout_detect_by_series", O.sql(
    "SELECT w.run_id, w.series_name, w.pair_idx, w.window_idx, round(w.std, 9) + 0.0 AS std, round(m.med, 9) AS median FROM windows w "
    "JOIN (SELECT run_id, series_name, pair_idx, median(std) AS med FROM windows GROUP BY ALL) m "
    "ON m.run_id = w.run_id AND m.series_name = w.series_name AND m.pair_idx = w.pair_idx WHERE w.std < 0.9 * m.med",
    "rec_two", SERIES_WINDOWS))
def dropout_detect_by_series(s, d):
    found = Q.dropout_detect(_channels_of_series(s, d), X.two_recordings(s, d), WINDOW_SEC, DROP_RATIO)
    return found.select("run_id", "series_name", "pair_idx", "window_idx", R("std").alias("std"), R("median").alias("median"))


@query("trace_layout_by_series", O.sql(
    "SELECT run_id, series_name, channel_pos, channel_pos AS rank, round(channel_pos * 4 * stddev_pop(value) OVER (PARTITION BY run_id, series_name), 9) + 0.0 AS offset_value "
    "FROM sig_two QUALIFY row_number() OVER (PARTITION BY run_id, series_name, channel_pos ORDER BY sample_idx) = 1", "sig_two"))
def trace_layout_by_series(s, d):
    return Q.trace_layout(X.two_series(s, d)).select("run_id", "series_name", "channel_pos", "rank", R("offset").alias("offset_value"))


SECOND_RECORDING = ("rec", f"SELECT run_id, n_samples, sfreq FROM rec_two WHERE series_name = '{X.rules.SECOND_SERIES}'")


@query("process_one_series", O.sql(
    O.ROUNDED_POWER, "rec_two", SECOND_RECORDING, *O.bipolar_steps("emb", sig="sig_second"), "bands",
    *O.welch_groups(**WELCH_ALL), *O.spectrum_steps(), O.BAND_POWER))
def process_one_series(s, d):
    results = PL.process(
        X.two_series(s, d), X.two_recordings(s, d), X.emb_electrodes(s, d), X.emb_channel_map(s, d), "chunked", series_name=X.rules.SECOND_SERIES, **WELCH_ALL)
    return rounded_power(results["band_power"])


@query("block_gaps", O.sql("SELECT * FROM gaps", "gaps"))
def block_gaps(s, d):
    return B.block_gaps(B.block_manifest(X.broken_signals(s, d))).drop("series_name")


@query("validate_runs", O.sql(
    "SELECT r.run_id, CASE WHEN b.reason IS NULL THEN 'succeeded' ELSE 'failed' END AS status, b.reason FROM rec r LEFT JOIN ("
    "SELECT run_id, CASE WHEN n_samples <= 32 THEN 'recording too short' ELSE g.reason END AS reason FROM rec LEFT JOIN ("
    "SELECT run_id, 'samples ' || problem || ' from ' || first_bad_sample || ' on in channel ' || channel_pos AS reason FROM gaps "
    "QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY first_bad_sample, channel_pos) = 1) g USING (run_id)) b ON b.run_id = r.run_id", "rec", "gaps"))
def validate_runs(s, d):
    blocks = X.broken_signals(s, d)
    recordings, electrodes, channels = X.recordings(s, d), X.electrodes(s, d), X.channel_map(s, d)
    layout = W.welch_layout(recordings, WELCH_ALL["nperseg"], WELCH_ALL["overlap"], WELCH_ALL["bin_sec"])
    return M.validate_runs(recordings, electrodes, channels, P.bipolar_pairs(electrodes), layout, blocks, B.block_manifest(blocks))


@query("time_bins_with_gaps", O.sql(
    "SELECT run_id, channel_pos, bin_idx, bin_idx * len AS start_sample, CAST(last - bin_idx * len + 1 AS INTEGER) AS n_samples, "
    "CASE WHEN held = last - bin_idx * len + 1 THEN round(total, 9) + 0.0 ELSE 'nan'::DOUBLE END AS total FROM ("
    "SELECT s.run_id, s.channel_pos, r.len, s.sample_idx // r.len AS bin_idx, max(s.sample_idx) AS last, count(*) AS held, sum(s.value) AS total "
    "FROM (SELECT DISTINCT * FROM sig_broken) s JOIN (SELECT run_id, CAST(floor(0.25 * sfreq) AS BIGINT) AS len FROM rec) r ON r.run_id = s.run_id GROUP BY ALL)", "rec", "sig_broken"))
def time_bins_with_gaps(s, d):
    bins = W.time_bins(X.broken_signals(s, d), X.recordings(s, d), 0.25)
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return bins.select("run_id", "channel_pos", "bin_idx", "start_sample", F.size("samples").alias("n_samples"), R(total).alias("total"))


@query("bipolar_welch_bin", O.sql(O.ROUNDED_POWER + " WHERE bin_idx = 2", *O.welch_power("all", 64, 0.5, 0.25, 200.0)))
def bipolar_welch_bin(s, d):
    pairs = P.bipolar_pairs(X.electrodes(s, d))
    power = BP.bipolar_welch_bin(X.signals(s, d), X.channel_map(s, d), pairs, X.recordings(s, d), 2, nperseg=64, overlap=0.5, bin_sec=0.25)
    return rounded_power(power)
