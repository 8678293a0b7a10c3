"""Electrode table: parsing, filters, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwave.functions.labels import contact_number, shaft_name
from leadwave.schema import ANATOMY_COLUMNS


def parse_electrode_label(electrodes: DataFrame, col: str = "location") -> DataFrame:
    """Add shaft and contact_num; both NULL where the label is not letters followed by digits."""
    label = F.col(col)
    return electrodes.withColumns({"shaft": shaft_name(label), "contact_num": contact_number(label)})


def drop_unparseable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("shaft").isNotNull())


def unparseable(parsed: DataFrame) -> DataFrame:
    """The rows drop_unparseable removes, for the report."""
    return parsed.where(F.col("shaft").isNull())


def is_out_of_brain(electrodes: DataFrame) -> Column:
    """True where any label column the table has mentions 'out of brain' in any case."""
    present = [c for c in ANATOMY_COLUMNS if c in electrodes.columns]
    hits = [F.coalesce(F.lower(F.col(c)).contains("out of brain"), F.lit(False)) for c in present]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def out_of_brain_filter(electrodes: DataFrame, keep_excluded: bool = False) -> DataFrame:
    """Remove electrodes outside the brain, or return just those for the report."""
    hit = is_out_of_brain(electrodes)
    return electrodes.where(hit if keep_excluded else ~hit)


def is_marked_exclude(electrodes: DataFrame) -> Column:
    if "std_label_keller" not in electrodes.columns:
        return F.lit(False)
    return F.col("std_label_keller").eqNullSafe("EXCLUDE")


def exclude_label_filter(electrodes: DataFrame, keep_excluded: bool = False) -> DataFrame:
    """Remove electrodes marked EXCLUDE; unmarked ones stay."""
    hit = is_marked_exclude(electrodes)
    return electrodes.where(hit if keep_excluded else ~hit)


def electrode_group_filter(electrodes: DataFrame, name: str = "sEEG") -> DataFrame:
    return electrodes.where(F.col("group_name") == name)


def channel_electrode_join(channel_map: DataFrame, electrodes: DataFrame) -> DataFrame:
    """Electrode row of every data column. Both sides are metadata; Spark picks the join."""
    return channel_map.join(electrodes, ["run_id", "electrode_id"])


def excluded_channels(electrodes: DataFrame, channel_map: DataFrame, n: int = 20) -> DataFrame:
    """The first n channels per run labelled exactly 'Out of Brain', in channel order."""
    label = F.col("JP_label_original") if "JP_label_original" in electrodes.columns else F.lit(None).cast("string")
    marked = electrodes.where(label == "Out of Brain")
    mapped = channel_electrode_join(channel_map, marked)
    order = Window.partitionBy("run_id").orderBy("channel_pos")
    return (
        mapped.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("run_id", "channel_pos", "electrode_id", "location", "rank")
    )


def excluded_channel_lookup(excluded: DataFrame, channel_map: DataFrame) -> DataFrame:
    """Data columns of the given electrodes; electrodes without one are skipped."""
    return excluded.select("run_id", "electrode_id", "location").join(channel_map, ["run_id", "electrode_id"])


def electrode_counts(electrodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per run: electrodes, excluded, unparseable and usable ones, shafts and pairs."""
    flagged = parse_electrode_label(electrodes).withColumn("excluded", is_out_of_brain(electrodes))
    kept = ~F.col("excluded")
    per_shaft = flagged.groupBy("run_id", "shaft").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("excluded").alias("n_excluded"),
        F.count_if(kept & F.col("shaft").isNull()).alias("n_unparseable"),
        F.count_if(kept & F.col("shaft").isNotNull()).alias("n_usable"),
    )
    counted = per_shaft.groupBy("run_id").agg(
        F.sum("n").alias("n_electrodes"),
        F.sum("n_excluded").alias("n_excluded"),
        F.sum("n_unparseable").alias("n_unparseable"),
        F.sum("n_usable").alias("n_usable"),
        F.count_if(F.col("n_usable") > 0).alias("n_shafts"),
    )
    paired = pairs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    return counted.join(paired, "run_id", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("bigint")))


def sort_contacts(parsed: DataFrame) -> DataFrame:
    """Rank of each contact on its shaft, by number and then by electrode."""
    order = Window.partitionBy("run_id", "shaft").orderBy("contact_num", "electrode_id")
    return drop_unparseable(parsed).withColumn("rank", F.row_number().over(order))


def sort_groups(parsed: DataFrame) -> DataFrame:
    """Shafts of each run in code-point order with their number of contacts."""
    shafts = drop_unparseable(parsed).groupBy("run_id", "shaft").agg(F.count(F.lit(1)).alias("n_contacts"))
    return shafts.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("shaft")))
