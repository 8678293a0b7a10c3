"""Whole processing of many runs: filter electrodes, pair, subtract, band power, tables, status."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwave import schema as S
from leadwave.operators.electrodes import drop_unparseable, exclude_label_filter, out_of_brain_filter, parse_electrode_label
from leadwave.operators.metadata import processing_params, session_metadata, validate_runs
from leadwave.operators.pairs import bipolar_pairs, bipolar_table
from leadwave.operators.spectrum import hop_layout, welch_layout
from leadwave.operators.stats import output_rate
from leadwave.plans.bandpower import bipolar_bandpower
from leadwave.session import materialise
from leadwave.sources.tables import append_ledger, new_generation, read_status, table_exists, write_bands, write_generation

# Settings of the four ways of processing.
PRESETS = {
    "chunked": {
        "method": "welch", "nperseg": 2000, "overlap": 0.5, "bin_sec": 60.0, "max_freq": 200.0,
        "pair_table": "suffixed", "parsed_columns": True,
    },
    "whole_file": {
        "method": "stft", "nperseg": 500, "overlap": 0.5, "pair_table": "averaged", "parsed_columns": True,
    },
    "rereferencing": {
        "method": "stft", "nperseg": 500, "overlap": 0.5, "pair_table": "averaged", "parsed_columns": False,
    },
    "in_brain": {
        "method": "stft", "window_sec": 1.0, "overlap_sec": 0.5, "pair_table": "averaged", "parsed_columns": False,
        "exclude": "out_of_brain",
    },
}

DEFAULTS = {
    "method": "welch", "nperseg": None, "overlap": 0.5, "window_sec": None, "overlap_sec": None, "bin_sec": 60.0,
    "max_freq": None, "detrend": "constant", "partial": "shrink", "pair_table": "averaged", "parsed_columns": False,
    "exclude": None, "compat_rate": False, "aligned": False,
}


def settings(preset: str, **overrides) -> dict:
    unknown = set(overrides) - set(DEFAULTS)
    if preset not in PRESETS or unknown:
        raise ValueError(f"unknown preset or settings: {preset}, {sorted(unknown)}")
    return {**DEFAULTS, **PRESETS[preset], **overrides}


def spectral_layout(recordings: DataFrame, chosen: dict) -> DataFrame:
    if chosen["method"] == "welch":
        return welch_layout(recordings, chosen["nperseg"], chosen["overlap"], chosen["bin_sec"])
    return hop_layout(
        recordings, chosen["nperseg"] or 500, chosen["overlap"], chosen["window_sec"], chosen["overlap_sec"]
    )


def nominal_rate(chosen: dict) -> Column:
    """Rate of the result from the settings: bins or steps per second."""
    if chosen["method"] == "welch":
        return F.lit(1.0 / chosen["bin_sec"])
    return F.col("sfreq") / (F.col("nperseg") - F.col("noverlap"))


def usable_electrodes(electrodes: DataFrame, exclude: str | None) -> DataFrame:
    if exclude is None:
        return electrodes
    filters = {"out_of_brain": out_of_brain_filter, "exclude_label": exclude_label_filter}
    return filters[exclude](electrodes)


def process(
    signals: DataFrame, recordings: DataFrame, electrodes: DataFrame, channel_map: DataFrame,
    preset: str = "chunked", bands: dict = S.BANDS, series_name: str | None = None, manifest: DataFrame | None = None, **overrides,
) -> dict[str, DataFrame | dict]:
    """Plan the processing of all runs. Metadata is computed once and measured; the signal is not touched but for its run names.

    Runs that fail a check of their metadata, or have signal but no recordings row, are listed in `status` and left out of
    the others. `series_name` takes one series of each run; without it a run with more than one is listed as failed. With `manifest`,
    the table of stored blocks, runs whose samples have gaps or repeats are failed too, without reading the signal; without it absent
    samples are NaN where they belong, and so is the power of windows that need them.
    Keys: band_power, electrodes, bands, sessions, layout, status, and the settings that `store` records.
    """
    if series_name is not None:
        signals = signals.where(F.col("series_name") == series_name)
        if "series_name" in recordings.columns:
            recordings = recordings.where(F.col("series_name") == series_name)
        # Electrodes and channels may be given for each series; tables without the column hold for all.
        electrodes, channel_map = (t.where(F.col("series_name") == series_name).drop("series_name") if "series_name" in t.columns else t for t in (electrodes, channel_map))
        manifest = manifest.where(F.col("series_name") == series_name) if manifest is not None else None
    recordings = materialise(recordings)
    chosen = settings(preset, **overrides)
    pairs = bipolar_pairs(usable_electrodes(electrodes, chosen["exclude"]))
    layout = spectral_layout(recordings, chosen)
    status = materialise(validate_runs(recordings, electrodes, channel_map, pairs, layout, signals, manifest))
    sound = status.where(F.col("status") == "succeeded").select("run_id")
    layout = layout.join(sound, "run_id", "left_semi")
    power = bipolar_bandpower(
        signals, channel_map, pairs, layout, chosen["method"], bands,
        chosen["max_freq"], chosen["detrend"], chosen["partial"], chosen["aligned"],
    )
    described = drop_unparseable(parse_electrode_label(electrodes)) if chosen["parsed_columns"] else electrodes
    return {
        "band_power": power,
        "electrodes": bipolar_table(described, pairs.join(sound, "run_id", "left_semi"), chosen["pair_table"]),
        "bands": S.bands_frame(signals.sparkSession, bands),
        "sessions": session_metadata(recordings.join(sound, "run_id", "left_semi")),
        "layout": layout,
        "status": status,
        "settings": {"preset": preset, "bands": bands, **overrides},
    }


def run_params(band_power: DataFrame, layout: DataFrame, preset: str, bands: dict = S.BANDS, **overrides) -> DataFrame:
    """Provenance per run of a result, best of a stored one: it counts its bins and pairs."""
    chosen = settings(preset, **overrides)
    rate = nominal_rate(chosen)
    if chosen["compat_rate"]:
        layout = layout.join(output_rate(band_power, chosen["bin_sec"]), "run_id")
        rate = F.col("rate")
    return processing_params(
        band_power, layout, chosen["method"], rate, bands, chosen["max_freq"], chosen["detrend"],
        chosen["bin_sec"] if chosen["method"] == "welch" else None,
    )


def settings_key(preset: str, bands: dict = S.BANDS, series_name: str | None = None, manifest: DataFrame | None = None, **overrides) -> str:
    """A digest of all that decides a run's result besides its data."""
    chosen = {"preset": preset, "bands": bands, "series_name": series_name, "gaps_fail": manifest is not None, **settings(preset, **overrides)}
    return hashlib.sha256(json.dumps(chosen, sort_keys=True, default=str).encode()).hexdigest()[:16]


def store(results: dict[str, DataFrame | dict], root: str, key: str | None = None, modified: DataFrame | None = None) -> None:
    """Write every table of a result as a new generation, and last the ledger rows that make it count.

    Parameters come from the stored band power and the settings of the result. A run is recorded as succeeded only if it has rows in this
    generation; one that has none is recorded as failed, whatever was stored for it before. A write that breaks off leaves no ledger row,
    so readers keep what they had. `modified` (run_id, modified) is recorded with the runs, as is `key`, the digest of the settings.
    """
    settings_used = dict(results["settings"])
    key = key or settings_key(**settings_used)
    bands = settings_used.pop("bands")
    spark = results["band_power"].sparkSession
    generation = new_generation()
    write_generation(results["band_power"], root, "band_power", generation)
    write_generation(results["electrodes"], root, "bipolar_electrodes", generation)
    write_bands(spark, root, bands)
    # Told by its folder, so that other generations are not even listed; a generation without rows has none.
    folder = f"band_power/generation={generation}"
    there_is = table_exists(spark, root, folder)
    stored = spark.read.schema(S.BAND_POWER).parquet(f"{root.rstrip('/')}/{folder}") if there_is else spark.createDataFrame([], S.BAND_POWER)
    params = run_params(stored, results["layout"], bands=bands, **settings_used)
    write_generation(results["sessions"].join(params, "run_id", "left"), root, "sessions", generation)
    there = F.col("stored").isNotNull()
    checked = results["status"].join(stored.select("run_id", F.lit(True).alias("stored")).distinct(), "run_id", "left")
    checked = checked.join(modified.select("run_id", "modified"), "run_id", "left") if modified is not None else checked.withColumn("modified", F.lit(None))
    sound = F.col("status") == "succeeded"
    ledger = checked.select(
        "run_id",
        F.when(sound & ~there, "failed").otherwise(F.col("status")).alias("status"),
        F.when(sound & ~there, "no result stored").otherwise(F.col("reason")).alias("reason"),
        F.lit(generation).alias("generation"), F.lit(key).alias("settings_key"), "modified",
    )
    append_ledger(ledger, root)


def process_pending(
    runs: DataFrame, signals: DataFrame, recordings: DataFrame, electrodes: DataFrame, channel_map: DataFrame, root: str,
    preset: str = "chunked", overwrite: bool = False, **overrides,
) -> DataFrame:
    """Process and store those of `runs` (run_id, and `modified`, the time of the input, if known) that have no successful result under
    `root` by these settings and of this input, or all with `overwrite`.

    Returns the last recorded status of every run asked for, finished ones included.
    """
    spark, key = signals.sparkSession, settings_key(preset, **overrides)
    timed = "modified" in runs.columns
    at = F.max(F.col("modified").cast("timestamp") if timed else F.lit(None).cast("timestamp")).alias("modified")
    asked = wanted = runs.groupBy("run_id").agg(at)
    if not overwrite:
        done = read_status(spark, root).where((F.col("status") == "succeeded") & (F.col("settings_key") == key))
        same = F.col("modified").isNull() | F.col("modified").eqNullSafe(F.col("seen"))
        finished = done.select("run_id", F.col("modified").alias("seen")).join(asked, "run_id").where(same).select("run_id")
        wanted = asked.join(finished, "run_id", "left_anti")
    wanted = materialise(wanted)
    if not wanted.isEmpty():
        tables = (t.join(wanted.select("run_id"), "run_id", "left_semi") for t in (signals, recordings, electrodes, channel_map))
        store(process(*tables, preset, **overrides), root, key, wanted)
    known = asked.select("run_id").join(read_status(spark, root), "run_id", "left")
    missing = F.col("status").isNull()
    return known.select(
        "run_id", F.coalesce("status", F.lit("failed")).alias("status"), F.when(missing, "no input").otherwise(F.col("reason")).alias("reason")
    )
