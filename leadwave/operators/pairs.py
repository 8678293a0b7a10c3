"""Bipolar pairs of neighbouring contacts and the table describing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadwave.functions.labels import nan_to_null, pair_label
from leadwave.operators.electrodes import drop_unparseable, parse_electrode_label
from leadwave.schema import COORDINATE_COLUMNS


def _neighbours(electrodes: DataFrame) -> DataFrame:
    """Every parseable electrode with the next row of its shaft, in shaft and contact order per run.

    Electrodes are metadata: one row stands for a whole channel of signal. Equal contact numbers
    are ordered by electrode_id.
    """
    parsed = drop_unparseable(parse_electrode_label(electrodes))
    order = Window.partitionBy("run_id").orderBy("shaft", "contact_num", "electrode_id")
    return (
        parsed.select("run_id", "shaft", "contact_num", "electrode_id", "location")
        .withColumn("next", F.lead(F.struct("shaft", "contact_num", "electrode_id", "location")).over(order))
        .withColumn("adjacent", F.coalesce(
            (F.col("next.shaft") == F.col("shaft")) & (F.col("next.contact_num") - F.col("contact_num") == 1),
            F.lit(False),
        ))
        .withColumn("pair_idx", (F.sum(F.col("adjacent").cast("int")).over(order) - 1).cast("int"))
    )


def bipolar_pairs(electrodes: DataFrame) -> DataFrame:
    """One row per pair: a contact and the next row of its shaft when the numbers differ by one."""
    return _neighbours(electrodes).where("adjacent").select(
        "run_id",
        "pair_idx",
        "shaft",
        F.col("electrode_id").alias("anode_id"),
        F.col("next.electrode_id").alias("cathode_id"),
        F.col("location").alias("anode_location"),
        F.col("next.location").alias("cathode_location"),
        F.col("contact_num").alias("anode_contact"),
        F.col("next.contact_num").alias("cathode_contact"),
        pair_label(F.col("location"), F.col("next.location")).alias("location"),
    )


def skipped_pairs(electrodes: DataFrame) -> DataFrame:
    """Neighbours on a shaft that form no pair because their numbers are not consecutive."""
    return (
        _neighbours(electrodes)
        .where(~F.col("adjacent") & (F.col("next.shaft") == F.col("shaft")))
        .select(
            "run_id",
            "shaft",
            F.col("electrode_id").alias("anode_id"),
            F.col("next.electrode_id").alias("cathode_id"),
            pair_label(F.col("location"), F.col("next.location")).alias("location"),
        )
    )


def bipolar_table(electrodes: DataFrame, pairs: DataFrame, mode: str = "averaged") -> DataFrame:
    """Electrode table of the pairs; which columns it has follows the electrode table.

    averaged: coordinates are the mean of both contacts, or the one that is known. suffixed:
    coordinates appear per contact like every other column. group and group_name are the anode's.
    """
    if mode not in ("averaged", "suffixed"):
        raise ValueError("mode must be 'averaged' or 'suffixed'")
    if mode == "suffixed" and "group" not in electrodes.columns:
        raise ValueError("the suffixed table needs a group column")
    keys = ("run_id", "electrode_id")
    doubles = {f.name for f in electrodes.schema.fields if f.dataType.typeName() in ("double", "float")}
    known = electrodes.withColumns({c: nan_to_null(F.col(c)) for c in electrodes.columns if c in doubles})
    columns = [c for c in known.columns if c not in keys]
    sides = {
        side: known.select("run_id", F.col("electrode_id").alias(f"{side}_id"), F.struct(*columns).alias(side))
        for side in ("anode", "cathode")
    }
    joined = pairs.select("run_id", "pair_idx", "location", "anode_id", "cathode_id")
    for side, table in sides.items():
        joined = joined.join(table, ["run_id", f"{side}_id"])
    output = [F.col("run_id"), F.col("pair_idx"), F.col("location")]
    for c in columns:
        anode, cathode = F.col("anode")[c], F.col("cathode")[c]
        if c == "location":
            continue
        if c in ("group", "group_name"):
            output.append(anode.alias(c))
        elif mode == "averaged" and c in COORDINATE_COLUMNS:
            output.append(F.coalesce((anode + cathode) / 2, anode, cathode).alias(c))
        else:
            output += [anode.alias(f"{c}_anode"), cathode.alias(f"{c}_cathode")]
    return joined.select(*output)
