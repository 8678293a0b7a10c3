"""Recordings, electrodes and runs derived by Spark from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import rules
from leadwave.operators.blocks import blocks_from_frames, blocks_from_samples, measure_recordings
from leadwave.schema import SERIES_NAME, SUBJECT

EMB_BLOCK = 128
EV_BLOCK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(rule: dict[str, str]) -> list:
    return [F.expr(text).alias("group" if name == "grp" else name) for name, text in rule.items()]


def emb_signals(spark: SparkSession, sf_dir: str, block_len: int = EMB_BLOCK) -> DataFrame:
    """One recording: every embedding is a time frame of all channels."""
    frames = table(spark, sf_dir, "embeddings").select(
        F.lit("emb").alias("run_id"), F.lit(SERIES_NAME).alias("series_name"),
        F.col("vec_id").alias("sample_idx"), F.col("embedding").alias("frame"),
    )
    return blocks_from_frames(frames, block_len)


def ev_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many recordings: events interleave the channels of a run; channels differ in length."""
    event = F.col("event_id")
    inside = event % rules.EV_RUN
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), F.call_function("div", event, F.lit(rules.EV_RUN)).cast("string")).alias("run_id"),
        F.lit(SERIES_NAME).alias("series_name"),
        (inside % rules.EV_CHANNELS).cast("int").alias("channel_pos"),
        F.call_function("div", inside, F.lit(rules.EV_CHANNELS)).alias("sample_idx"),
        (F.col("value").cast("float") / rules.EV_SCALE).alias("value"),
    )


def ev_signals(spark: SparkSession, sf_dir: str, block_len: int = EV_BLOCK) -> DataFrame:
    return blocks_from_samples(ev_samples(spark, sf_dir), block_len)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["run_id", "series_name", "channel_pos", "block_idx", "start_sample", "samples"]
    return emb_signals(spark, sf_dir).select(columns).unionByName(ev_signals(spark, sf_dir).select(columns))


def drop_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long recording with a stretch of zeros in some channels."""
    blocks = emb_signals(spark, sf_dir)
    start = F.col("start_sample")

    def silence(x, i):
        return F.when(((start + i) >= 200) & ((start + i) < 300), F.lit(0.0).cast("float")).otherwise(x)

    return blocks.withColumn(
        "samples", F.when(F.col("channel_pos") % 7 == 0, F.transform("samples", silence)).otherwise(F.col("samples"))
    )


def with_rate(measured: DataFrame) -> DataFrame:
    """400 Hz, but 500 Hz for every second of the many recordings; and a session of each run."""
    odd = F.col("run_id").startswith("ev-") & (F.regexp_extract("run_id", r"(\d+)$", 1).try_cast("int") % 2 == 1)
    started = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return measured.withColumns({
        "sfreq": F.when(odd, 500.0).otherwise(400.0),
        "session_description": F.concat(F.lit("session of "), "run_id"),
        "identifier": F.col("run_id"),
        "session_start_time": started,
        "timestamps_reference_time": started,
        "experimenter": F.lit(None).cast("string"),
        "lab": F.lit("lab"),
        "institution": F.lit("institution"),
        "subject": F.lit(None).cast(SUBJECT),
    })


def emb_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").agg(
        (F.max("vec_id") + 1).alias("n_samples"), F.max(F.size("embedding")).alias("n_channels")
    )
    return with_rate(frames.select(
        F.lit("emb").alias("run_id"), F.lit(SERIES_NAME).alias("series_name"), "n_samples", "n_channels"
    ))


def ev_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ev_samples(spark, sf_dir).groupBy("run_id", "series_name").agg(
        (F.max("sample_idx") + 1).alias("n_samples"), (F.max("channel_pos") + 1).alias("n_channels")
    )
    return with_rate(runs)


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_recordings(spark, sf_dir).unionByName(ev_recordings(spark, sf_dir))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings as measured from the blocks, the way an ingest job does it."""
    return with_rate(measure_recordings(signals(spark, sf_dir)))


def emb_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    widest = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("n"))
    return widest.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))


def emb_electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_positions(spark, sf_dir).select(F.lit("emb").alias("run_id"), *_columns(rules.EMB_ELECTRODES))


def emb_channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_positions(spark, sf_dir).select(
        F.lit("emb").alias("run_id"), (63 - F.col("pos")).alias("channel_pos"), (100 + F.col("pos")).alias("electrode_id")
    )


def _part_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "*", F.expr(rules.PART_RUN).alias("run_id"), F.expr(rules.PART_POS).alias("pos")
    )


def part_electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_positions(spark, sf_dir).select("run_id", *_columns(rules.PART_ELECTRODES))


def part_channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_positions(spark, sf_dir).select(
        "run_id", (63 - F.col("pos")).alias("channel_pos"), (100 + F.col("pos")).alias("electrode_id")
    )


def _ev_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev_samples(spark, sf_dir).select("run_id", "channel_pos").distinct()


def ev_electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ev_channels(spark, sf_dir).select("run_id", *_columns(rules.EV_ELECTRODES))


def ev_channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ev_channels(spark, sf_dir).select("run_id", "channel_pos", (500 + F.col("channel_pos")).alias("electrode_id"))


def electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_electrodes(spark, sf_dir).unionByName(ev_electrodes(spark, sf_dir), allowMissingColumns=True)


def channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_channel_map(spark, sf_dir).unionByName(ev_channel_map(spark, sf_dir))


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.expr(rules.RUN_PATH).alias("path"), F.expr(rules.RESULT_PATH).alias("output_path"), "c_custkey", "c_nationkey"
    )


def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_files(spark, sf_dir).where(F.col("c_custkey") % 3 == 0).select("output_path")


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_files(spark, sf_dir).select(
        F.col("path").alias("run_id"), F.when(F.col("c_custkey") % 13 == 0, "failed").otherwise("succeeded").alias("status")
    )


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session metadata of many runs: every order is a session, some without a subject."""
    subject = F.struct(
        F.col("o_custkey").cast("string").alias("subject_id"), F.lit(None).cast("string").alias("age"),
        F.col("o_orderstatus").alias("sex"), F.lit("Homo sapiens").alias("species"), F.lit(None).cast("string").alias("description"),
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderpriority").alias("session_description"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("identifier"),
        F.col("o_orderdate").alias("session_start_time"),
        F.col("o_orderdate").alias("timestamps_reference_time"),
        F.lit(None).cast("string").alias("experimenter"),
        F.lit("lab").alias("lab"),
        F.lit("institution").alias("institution"),
        F.when(F.col("o_orderstatus") != "P", subject).alias("subject"),
    )


def second_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of the long recording beside the first: another rate, other values, three fifths as long."""
    frames = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 5 < 3)
    return blocks_from_frames(frames.select(
        F.lit("emb").alias("run_id"), F.lit(rules.SECOND_SERIES).alias("series_name"),
        (F.call_function("div", F.col("vec_id"), F.lit(5)) * 3 + F.col("vec_id") % 5).alias("sample_idx"),
        F.transform("embedding", lambda x: x * F.lit(0.5).cast("float")).alias("frame"),
    ), EMB_BLOCK)


def two_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_signals(spark, sf_dir).unionByName(second_series(spark, sf_dir))


def two_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As measured at ingest, a row for each series."""
    measured_rows = with_rate(measure_recordings(two_series(spark, sf_dir)))
    return measured_rows.withColumn("sfreq", F.when(F.col("series_name") == rules.SECOND_SERIES, 250.0).otherwise(F.col("sfreq")))


def broken_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings; the long one without its third block in channel 5 and its first in channel 9, the first of the many with
    its second block of channel 3 stored twice. The other recordings are whole."""
    blocks = signals(spark, sf_dir)
    at = lambda run, channel, block: (F.col("run_id") == run) & (F.col("channel_pos") == channel) & (F.col("block_idx") == block)
    return blocks.where(~at("emb", 5, 2) & ~at("emb", 9, 0)).unionByName(blocks.where(at("ev-0", 3, 1)))
