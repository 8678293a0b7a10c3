"""Spark-native analytics for multichannel recordings stored as blocks of samples."""

from leadwave.operators.blocks import blocks_from_frames, blocks_from_samples, sample_rows
from leadwave.operators.electrodes import exclude_label_filter, out_of_brain_filter, parse_electrode_label
from leadwave.operators.pairs import bipolar_pairs, bipolar_table
from leadwave.operators.rereference import bipolar_subtract
from leadwave.plans.bandpower import bandpower_stft, bandpower_welch, bandpower_welch_bin
from leadwave.plans.pipeline import process, store
from leadwave.plans.reports import bandpower_qc, bandpower_report, bipolar_qc
from leadwave.sources.catalog import discover_runs, pending_runs

__all__ = [
    "bandpower_qc", "bandpower_report", "bandpower_stft", "bandpower_welch", "bandpower_welch_bin", "bipolar_pairs", "bipolar_qc",
    "bipolar_subtract", "bipolar_table", "blocks_from_frames", "blocks_from_samples", "discover_runs", "exclude_label_filter",
    "out_of_brain_filter", "parse_electrode_label", "pending_runs", "process", "sample_rows", "store",
]
