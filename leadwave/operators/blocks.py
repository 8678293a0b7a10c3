"""Block layout of signals: building it, cutting it anew, slicing it and unrolling it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwave.functions.frames import turn_frames
from leadwave.session import join_metadata

RUN_SERIES = ("run_id", "series_name")


def series_key(*tables: DataFrame) -> list[str]:
    """What names a recording in all of these tables: run and series, or the run alone where a table has no series."""
    return [c for c in RUN_SERIES if all(c in t.columns for t in tables)]


def blocks_from_frames(frames: DataFrame, block_len: int) -> DataFrame:
    """Turn time-major rows (run_id, series_name, sample_idx, frame ARRAY) into channel blocks.

    A group is one block of one run: block_len frames, however long the recording is.
    """
    block = F.call_function("div", F.col("sample_idx"), F.lit(block_len)).alias("block_idx")
    gathered = frames.groupBy(*RUN_SERIES, block).agg(
        F.sort_array(F.collect_list(F.struct("sample_idx", "frame"))).alias("rows")
    )
    timed = gathered.select(
        *RUN_SERIES,
        "block_idx",
        F.col("rows.sample_idx")[0].alias("start_sample"),
        F.col("rows.frame").cast("array<array<float>>").alias("frames"),
    )
    channels = timed.select(
        *RUN_SERIES, "block_idx", "start_sample", F.posexplode_outer(turn_frames()("frames")).alias("channel_pos", "samples")
    ).where(F.col("channel_pos").isNotNull())
    return channels.select(*RUN_SERIES, "channel_pos", "block_idx", "start_sample", "samples")


def blocks_from_samples(samples: DataFrame, block_len: int) -> DataFrame:
    """Turn long rows (run_id, series_name, channel_pos, sample_idx, value) into channel blocks."""
    block = F.call_function("div", F.col("sample_idx"), F.lit(block_len)).alias("block_idx")
    row = F.struct("sample_idx", F.col("value").cast("float").alias("value"))
    gathered = samples.groupBy(*RUN_SERIES, "channel_pos", block).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return gathered.select(
        *RUN_SERIES, "channel_pos", "block_idx",
        F.col("rows.sample_idx")[0].alias("start_sample"), F.col("rows.value").alias("samples"),
    )


def sample_rows(blocks: DataFrame) -> DataFrame:
    """One row per sample: every column but the array, plus sample_idx and value DOUBLE."""
    carried = [c for c in blocks.columns if c not in ("samples", "start_sample", "block_idx")]
    return blocks.select(*carried, "start_sample", F.posexplode("samples").alias("offset", "value")).select(
        *carried,
        (F.col("start_sample") + F.col("offset")).alias("sample_idx"),
        F.col("value").cast("double").alias("value"),
    )


def sample_values(blocks: DataFrame) -> DataFrame:
    """One row per sample without its position, for aggregates that ignore order."""
    carried = [c for c in blocks.columns if c not in ("samples", "start_sample", "block_idx")]
    return blocks.select(*carried, F.explode("samples").alias("value")).withColumn("value", F.col("value").cast("double"))


def slice_samples(blocks: DataFrame, start: Column | int, end: Column | int, block_len: int | None = None) -> DataFrame:
    """Keep samples [start, end) of every channel.

    With literal bounds the block filter reaches the scan; block_len of the stored layout lets the
    lower bound be pushed down too. Blocks at the edges are cut.
    """
    literal = isinstance(start, int) and isinstance(end, int)
    lo, hi = (F.lit(b).cast("bigint") if isinstance(b, int) else b for b in (start, end))
    first, size = F.col("start_sample"), F.size("samples")
    kept = blocks.where(first < hi)
    if block_len is not None and literal:
        kept = kept.where(F.col("block_idx").between(start // block_len, (end - 1) // block_len))
    kept = kept.where(first + size > lo)
    skip = F.greatest(lo - first, F.lit(0).cast("bigint"))
    stop = F.greatest(F.least(hi - first, size.cast("bigint")), skip)
    cut = F.when((skip == 0) & (stop == size), F.col("samples")).otherwise(
        F.slice("samples", (skip + 1).cast("int"), (stop - skip).cast("int"))
    )
    return kept.withColumns({"samples": cut, "start_sample": first + skip})


def cut_pieces(blocks: DataFrame, keys: list[str], length: Column | int, halo: Column | int = 0) -> DataFrame:
    """Cut blocks at the edges of bins [b * length, (b + 1) * length + halo); the bin becomes block_idx.

    A sample inside a halo goes to both bins, so no bin needs its neighbour later.
    """
    length, halo = (F.lit(v).cast("bigint") if isinstance(v, int) else v.cast("bigint") for v in (length, halo))
    zero = F.lit(0).cast("bigint")
    pieces = (
        blocks.withColumn("_size", F.size("samples").cast("bigint"))
        .where(F.col("_size") > 0)
        .withColumns({"_length": length, "_halo": halo})
    )
    start = F.col("start_sample")
    first = F.call_function("div", F.greatest(start - F.col("_halo"), zero), F.col("_length"))
    last = F.call_function("div", start + F.col("_size") - 1, F.col("_length"))
    pieces = pieces.withColumn("block_idx", F.explode(F.sequence(first, last)))
    bin_start = F.col("block_idx") * F.col("_length")
    pieces = pieces.withColumns(
        {
            "_skip": F.greatest(bin_start - start, zero),
            "_stop": F.least(bin_start + F.col("_length") + F.col("_halo") - start, F.col("_size")),
        }
    )
    piece = F.when((F.col("_skip") == 0) & (F.col("_stop") == F.col("_size")), F.col("samples")).otherwise(
        F.slice("samples", (F.col("_skip") + 1).cast("int"), (F.col("_stop") - F.col("_skip")).cast("int"))
    )
    return pieces.select(*keys, "block_idx", (start + F.col("_skip")).alias("start_sample"), piece.alias("samples"))


def assemble(pieces: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Join the pieces of each bin of `length` samples (a column) in order; no shuffle when they are placed by some of the keys and the bin.

    Every sample keeps its place in time: a sample missing before a stored one is NaN, and one that is stored twice counts once.
    """
    parts = F.sort_array(F.collect_list(F.struct("start_sample", "samples")))
    start = F.col("block_idx") * F.col(length)
    gathered = pieces.groupBy(*keys, "block_idx", length).agg(parts.alias("parts"))
    element = pieces.schema["samples"].dataType.elementType
    nothing = F.struct(start.alias("at"), F.array().cast(pieces.schema["samples"].dataType).alias("samples"))

    def follow(done: Column, part: Column) -> Column:
        gap, size = part["start_sample"] - done["at"], F.size(part["samples"])
        unseen = F.when(gap == 0, part["samples"]).when(
            gap > 0, F.concat(F.array_repeat(F.lit(float("nan")).cast(element), gap.cast("int")), part["samples"])
        ).otherwise(F.slice(part["samples"], (1 - gap).cast("int"), F.greatest(size + gap, F.lit(0)).cast("int")))
        return F.struct(F.greatest(done["at"], part["start_sample"] + size).alias("at"), F.concat(done["samples"], unseen).alias("samples"))

    ends = F.transform("parts", lambda p: p["start_sample"] + F.size(p["samples"]))
    joined = F.forall(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.col("parts")[i]["start_sample"] == F.get("ends", i - 1))
    on_time = F.col("parts")[0]["start_sample"] == start
    whole = (
        F.when((F.size("parts") == 1) & on_time, F.col("parts")[0]["samples"])
        .when(on_time & F.when(F.size("parts") > 1, joined).otherwise(False), F.flatten(F.col("parts.samples")))
        .otherwise(F.aggregate("parts", nothing, follow)["samples"])
    )
    return gathered.withColumn("ends", ends).select(*keys, "block_idx", start.alias("start_sample"), whole.alias("samples"))


def recut(blocks: DataFrame, keys: list[str], length: Column | int, halo: Column | int = 0) -> DataFrame:
    """Blocks of another length per key, each followed by halo samples of the next."""
    pieces = cut_pieces(blocks.withColumn("_length", F.lit(length) if isinstance(length, int) else length), [*keys, "_length"], length, halo)
    return assemble(pieces, keys, "_length")


def block_manifest(signals: DataFrame) -> DataFrame:
    """(run_id, series_name, channel_pos, block_idx, start_sample, n): the stored blocks without their samples, to be written with
    them. Selections of time and checks of gaps then read this table and not the signal."""
    return signals.select(*RUN_SERIES, "channel_pos", "block_idx", "start_sample", F.size("samples").cast("bigint").alias("n"))


def block_gaps(manifest: DataFrame) -> DataFrame:
    """(run_id, series_name, channel_pos, first_bad_sample, problem) of every channel whose blocks do not follow each other from
    sample 0 on: 'missing' where samples are absent before a stored one, 'repeated' where samples are stored again.

    Rows are blocks; each is compared with the furthest end of the blocks before it in its channel. That a channel ends before the
    others is no gap.
    """
    channel = Window.partitionBy(*RUN_SERIES, "channel_pos").orderBy("start_sample", "n")
    reached = F.coalesce(F.max(F.col("start_sample") + F.col("n")).over(channel.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.where("n > 0").withColumn("reached", reached).where("start_sample != reached")
    bad = F.least("start_sample", "reached")
    problem = F.when(F.col("start_sample") > F.col("reached"), "missing").otherwise("repeated")
    first = F.min(F.struct(bad.alias("at"), problem.alias("problem")))
    return placed.groupBy(*RUN_SERIES, "channel_pos").agg(first.alias("first")).select(
        *RUN_SERIES, "channel_pos", F.col("first.at").alias("first_bad_sample"), "first.problem"
    )


def measure_recordings(signals: DataFrame) -> DataFrame:
    """n_samples and n_channels per run, taken from the blocks at ingest.

    Channels are reduced first, so a long run adds one row per channel to the second step.
    """
    channels = signals.groupBy(*RUN_SERIES, "channel_pos").agg(
        F.max(F.col("start_sample") + F.size("samples")).alias("n")
    )
    return channels.groupBy(*RUN_SERIES).agg(
        F.max("n").alias("n_samples"), F.count(F.lit(1)).cast("int").alias("n_channels")
    )


def channel_arrays(signals: DataFrame, names: DataFrame, ch_type: str = "seeg") -> DataFrame:
    """Channel-major view with names: blocks of a channel in order, with its label and type.

    The blocks stay separate rows: a whole recording of one channel has no size bound.
    """
    on = [*series_key(signals, names), "channel_pos"]
    named = join_metadata(signals, names.select(*on, F.col("location").alias("channel_name")), on)
    return named.select(
        *RUN_SERIES, "channel_pos", "channel_name", F.lit(ch_type).alias("ch_type"), "block_idx", "start_sample", "samples"
    )
