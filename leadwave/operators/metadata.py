"""Session metadata, parameters and status of processed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwave import schema as S
from leadwave.operators.blocks import block_gaps


def series_summary(recordings: DataFrame) -> DataFrame:
    """Size of a series from its metadata alone: samples, channels, rate, minutes, GiB as float32."""
    return recordings.select(
        "run_id",
        "series_name",
        "n_samples",
        "n_channels",
        "sfreq",
        (F.col("n_samples") / F.col("sfreq") / 60).alias("duration_min"),
        (F.col("n_samples") * F.col("n_channels") * 4 / F.lit(1024.0**3)).alias("size_gib"),
    )


def session_metadata(recordings: DataFrame) -> DataFrame:
    """Session row of the result; a run without subject stays without one."""
    return recordings.select(
        "run_id",
        F.concat("session_description", F.lit(S.SESSION_SUFFIX)).alias("session_description"),
        F.concat("identifier", F.lit(S.IDENTIFIER_SUFFIX)).alias("identifier"),
        "session_start_time",
        "timestamps_reference_time",
        "experimenter",
        "lab",
        "institution",
        "subject",
        F.lit(S.DEVICE_NAME).alias("device"),
        F.lit(S.DEVICE_DESCRIPTION).alias("device_description"),
        F.lit(S.GROUP_NAME).alias("group_name"),
        F.lit(S.GROUP_DESCRIPTION).alias("group_description"),
        F.lit(S.GROUP_LOCATION).alias("group_location"),
        F.lit(S.POWER_METRIC).alias("metric"),
        F.lit(S.POWER_UNIT).alias("unit"),
    )


def processing_params(
    band_power: DataFrame,
    layout: DataFrame,
    method: str,
    rate: Column,
    bands: dict = S.BANDS,
    max_freq: float | None = None,
    detrend: str | None = "constant",
    bin_sec: float | None = None,
    source_file: Column | None = None,
    processed_at: Column | None = None,
) -> DataFrame:
    """Provenance of each run as JSON: the settings really used, and the counts of the result."""
    counts = band_power.groupBy("run_id", "pair_idx").agg(F.max("bin_idx").alias("last")).groupBy("run_id").agg(
        (F.max("last") + 1).alias("n_time_bins"), F.count(F.lit(1)).alias("n_bipolar_pairs")
    )
    limits = F.struct(*[F.array(F.lit(lo), F.lit(hi)).alias(name) for name, (lo, hi) in bands.items()])
    fields = {
        "processing_timestamp": F.current_timestamp() if processed_at is None else processed_at,
        "rereferencing_method": F.lit("bipolar"),
        "method": F.lit(method),
        "nperseg": F.col("nperseg"),
        "noverlap": F.col("noverlap"),
        "overlap_fraction": F.col("noverlap") / F.col("nperseg"),
        "window_function": F.lit("hann"),
        "scaling": F.lit("density"),
        "detrend": F.lit(detrend if detrend is not None else "none"),
        "max_frequency": F.lit(max_freq).cast("double"),
        "chunk_duration_sec": F.lit(bin_sec).cast("double"),
        "time_bin_method": F.lit("non_overlapping" if method == "welch" else "hopping"),
        "frequency_bands": limits,
        "original_sampling_rate": F.col("sfreq"),
        "output_sampling_rate": rate,
        "n_time_bins": F.col("n_time_bins"),
        "n_bipolar_pairs": F.col("n_bipolar_pairs"),
        "source_file": F.col("run_id") if source_file is None else source_file,
    }
    record = F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
    return layout.join(counts, "run_id").select("run_id", record.alias("params"))


def validate_runs(
    recordings: DataFrame, electrodes: DataFrame, channel_map: DataFrame, pairs: DataFrame, layout: DataFrame, signals: DataFrame | None = None,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Status of each run before the signal is touched; works on metadata only, and on the names of runs and series in `signals`.
    With `manifest` (see block_manifest) a run whose stored blocks leave samples out, or hold them twice, is failed with its first bad sample.

    The keys that must be unique within a run are counted together, in one grouping.
    """
    def keys(table, kind, column):
        return table.select("run_id", F.lit(kind).alias("kind"), F.col(column).cast("bigint").alias("key"))

    listed = (
        keys(electrodes, "electrode", "electrode_id")
        .unionAll(keys(channel_map, "mapped electrode", "electrode_id"))
        .unionAll(keys(channel_map, "channel", "channel_pos"))
        .unionAll(keys(pairs, "pair", "pair_idx"))
    )
    counted = listed.groupBy("run_id", "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy("run_id").agg(
        F.bool_or(F.col("n") > 1).alias("repeated"), F.bool_or(F.col("kind") == "pair").alias("paired")
    )
    lengths = recordings.groupBy("run_id").agg(F.max("n_samples").alias("n_samples"), F.count(F.lit(1)).alias("listed"))
    cuts = layout.groupBy("run_id").agg(F.max("nperseg").alias("nperseg"), F.max("noverlap").alias("noverlap"))
    checked = lengths.join(found, "run_id", "left").join(cuts, "run_id", "left")
    if signals is not None:
        series = signals.select("run_id", "series_name").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("series"))
        checked = checked.join(series, "run_id", "full")
    else:
        checked = checked.withColumn("series", F.lit(1))
    if manifest is None:
        checked = checked.withColumn("bad", F.lit(None).cast("string"))
    else:
        told = F.struct("first_bad_sample", "channel_pos", "series_name", "problem")
        worst = block_gaps(manifest).groupBy("run_id").agg(F.min(told).alias("w"))
        text = F.format_string("samples %s from %d on in channel %d", "w.problem", "w.first_bad_sample", "w.channel_pos")
        checked = checked.join(worst.select("run_id", text.alias("bad")), "run_id", "left")
    reason = (
        F.when(F.col("listed").isNull(), "no recordings row")
        .when(F.col("listed") > 1, "recording listed twice")
        .when(F.col("series") > 1, "more than one series")
        .when(F.col("repeated"), "electrode or channel listed twice")
        .when(~F.coalesce("paired", F.lit(False)), "no bipolar pairs")
        .when(F.col("n_samples").isNull(), "unknown length")
        .when(F.col("noverlap") >= F.col("nperseg"), "overlap not below segment length")
        .when(F.col("n_samples") <= F.col("noverlap"), "recording too short")
        .when(F.col("bad").isNotNull(), F.col("bad"))
    )
    return checked.select(
        "run_id", F.when(reason.isNull(), "succeeded").otherwise("failed").alias("status"), reason.alias("reason")
    )


def run_status_summary(status: DataFrame) -> DataFrame:
    """Processed, succeeded and failed runs; all_ok when none failed."""
    failed = F.col("status") == "failed"
    return status.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(failed).alias("failed"),
    ).withColumn("all_ok", F.col("failed") == 0)


def failed_runs(status: DataFrame) -> DataFrame:
    """Names of the failed runs, as rows because their number has no bound."""
    return status.where(F.col("status") == "failed")
