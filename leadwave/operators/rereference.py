"""Bipolar re-referencing of signal blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadwave.operators.blocks import RUN_SERIES, assemble, cut_pieces, series_key
from leadwave.session import is_small, join_metadata, join_spread, materialise

# Contacts of a shaft that are put together in one group of rows; it bounds the group, not the pairs.
CONTACTS_PER_GROUP = 32

# Where channels come together, with the block: some contacts of one shaft.
GROUP = ["run_id", "series_name", "shaft", "bucket"]


def montage(pairs: DataFrame, channel_map: DataFrame) -> DataFrame:
    """Which channels take part in the pairs, and where they are put together.

    Channels of a shaft meet in groups of CONTACTS_PER_GROUP contacts; the contact at a group's edge
    belongs to both groups. In contact order the row after an anode is its cathode.
    """
    bucket = F.call_function("div", F.col("anode_contact"), F.lit(CONTACTS_PER_GROUP)).alias("bucket")
    anode = F.struct(
        F.col("anode_id").alias("electrode_id"),
        F.col("anode_contact").alias("contact_num"),
        "pair_idx",
        "location",
        "cathode_id",
    )
    none = {f: F.lit(None).cast(t) for f, t in pairs.select("pair_idx", "location", "cathode_id").dtypes}
    cathode = F.struct(
        F.col("cathode_id").alias("electrode_id"),
        F.col("cathode_contact").alias("contact_num"),
        *[value.alias(name) for name, value in none.items()],
    )
    members = pairs.select("run_id", "shaft", bucket, F.explode(F.array(anode, cathode)).alias("m"))
    roles = members.select("run_id", "shaft", "bucket", "m.*").groupBy(
        "run_id", "shaft", "bucket", "electrode_id", "contact_num"
    ).agg(*[F.max(c).alias(c) for c in none])
    return roles.join(channel_map, [*series_key(roles, channel_map), "electrode_id"])


def _place(signals: DataFrame, members: DataFrame, layout: DataFrame | None, keys: list[str], aligned: bool) -> DataFrame:
    """Signal rows with their roles, cut to the layout and shuffled to where their group comes together.

    Few members are broadcast, and channels outside every pair drop out before the shuffle. Many members
    meet the signal after it: they are spread over the bins of their run and shuffled to (run, bin) like
    the signal itself. With spark.sql.requireAllClusterKeysForCoPartition=false Spark then joins without
    another shuffle; the default gives the same rows with one more.
    """
    small = is_small(members)
    if layout is None or aligned:
        on = [*series_key(signals, members), "channel_pos"]
        return signals.join(F.broadcast(members), on) if small else join_spread(signals, members, on)
    if small:
        met = signals.join(F.broadcast(members), [*series_key(signals, members), "channel_pos"])
        pieces = cut_pieces(met, [*keys, "block_len"], F.col("block_len"), F.col("halo"))
        return assemble(pieces.repartition(*GROUP, "block_idx"), keys, "block_len")
    on = series_key(signals, layout)
    sized = materialise(layout.select(*on, "block_len", "halo"))
    columns = ["run_id", "series_name", "channel_pos"]
    pieces = cut_pieces(join_metadata(signals, sized, on), columns, F.col("block_len"), F.col("halo"))
    last = F.call_function("div", F.col("n_samples") - 1, F.col("block_len"))
    spread = members.withColumn("block_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    met = pieces.repartition("run_id", "block_idx").join(
        spread.repartition("run_id", "block_idx"), [*series_key(pieces, spread), "channel_pos", "block_idx"]
    )
    return assemble(met, keys, "block_len")


def pair_blocks(
    signals: DataFrame, channel_map: DataFrame, pairs: DataFrame, layout: DataFrame | None = None, aligned: bool = False
) -> DataFrame:
    """Blocks of both contacts of each pair, side by side as samples (anode) and cathode_samples.

    The signal is shuffled once, to groups of contacts of one shaft and block. Both arrays are cut to the samples that both contacts
    have, by their places in time. `layout` (run_id, n_samples, block_len, halo, plus columns to carry) cuts the blocks
    anew in that same shuffle, or with `aligned` only checks that they are cut that way already.
    """
    members = montage(pairs, channel_map)
    carried: list[str] = []
    if layout is not None:
        members = members.join(layout, series_key(members, layout))
        carried = [c for c in layout.columns if c not in (*RUN_SERIES, "n_samples", "block_len", "halo")]
    member = ["electrode_id", "contact_num", "pair_idx", "location", "cathode_id", *carried]
    placed = _place(signals, materialise(members), layout, GROUP + member, aligned)
    if layout is not None and aligned:
        fits = (F.col("start_sample") == F.col("block_idx") * F.col("block_len")) & (
            (F.size("samples") <= F.col("block_len")) & (F.col("halo") == 0)
        )
        placed = placed.withColumn(
            "samples", F.when(fits, F.col("samples")).otherwise(F.raise_error(F.lit("blocks are not cut to the bins")))
        )
    together = Window.partitionBy(*GROUP, "block_idx").orderBy("contact_num", "electrode_id")
    following = placed.select(
        *GROUP, *member, "block_idx", "start_sample", "samples",
        F.lead("electrode_id").over(together).alias("next_id"),
        F.lead("samples").over(together).alias("next_samples"),
        F.lead("start_sample").over(together).alias("next_start"),
    ).where(F.col("pair_idx").isNotNull() & (F.col("next_id") == F.col("cathode_id")))
    first = F.greatest("start_sample", "next_start")
    end = F.least(F.col("start_sample") + F.size("samples"), F.col("next_start") + F.size("next_samples"))
    shared = (end - first).cast("int")

    def both(array, start):
        whole = (F.col(start) == first) & (F.size(array) == shared)
        return F.when(whole, F.col(array)).otherwise(F.slice(array, (first - F.col(start) + 1).cast("int"), shared))

    return following.where(shared > 0).select(
        "run_id", "series_name", "pair_idx", "location", *carried, "block_idx", first.alias("start_sample"),
        both("samples", "start_sample").alias("samples"), both("next_samples", "next_start").alias("cathode_samples"),
    )


def bipolar_subtract(signals: DataFrame, channel_map: DataFrame, pairs: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Anode minus cathode per pair, block by block; a pair ends where its shorter channel ends."""
    blocks = pair_blocks(signals, channel_map, pairs, layout)
    difference = F.zip_with("samples", "cathode_samples", lambda a, c: a.cast("double") - c.cast("double"))
    return blocks.withColumn("samples", difference).drop("cathode_samples")
