"""Run discovery: which inputs exist, which still need a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadwave.functions.labels import result_path, subject_key
from leadwave.session import broadcast_if_small

# Fixed value: where recordings lie under the data folder.
RUN_PATTERN = r"/sub-[^/]*/ses-[^/]*/ieeg/sub-[^/]*_ses-[^/]*_run-[^/]*\.nwb$"
SUBJECT_PATTERN = r"/sub-([^/]*)/ses-[^/]*/ieeg/sub-"


def list_paths(spark: SparkSession, root: str, suffix: str = ".nwb") -> DataFrame:
    """Paths below a folder; no file content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    return files.load(root).select("path")


def normalize_subjects(subjects: DataFrame, col: str = "subject") -> DataFrame:
    return subjects.withColumn("subject_id", subject_key(F.col(col)))


def discover_runs(paths: DataFrame, subjects: DataFrame | list[str] | str | None = None, distinct: bool = False) -> DataFrame:
    """Input paths of recordings, of all or the given subjects.

    A subject named twice gives its files twice unless distinct is set.
    """
    found = paths.where(F.col("path").rlike(RUN_PATTERN)).select(F.col("path").alias("input_path"))
    if subjects is None:
        return found
    if isinstance(subjects, str):
        subjects = [subjects]
    if isinstance(subjects, list):
        subjects = paths.sparkSession.createDataFrame([(s,) for s in subjects], "subject string")
    wanted = normalize_subjects(subjects).select("subject_id")
    wanted = wanted.distinct() if distinct else wanted
    keyed = found.withColumn("subject_id", F.regexp_extract("input_path", SUBJECT_PATTERN, 1))
    named = F.concat(F.lit("/sub-"), F.col("subject_id"), F.lit("_ses-"))
    return keyed.where(F.contains("input_path", named)).join(broadcast_if_small(wanted), "subject_id").select("input_path")


def with_output_path(runs: DataFrame) -> DataFrame:
    return runs.withColumn("output_path", result_path(F.col("input_path")))


def pending_runs(runs: DataFrame, outputs: DataFrame, overwrite: bool = False) -> DataFrame:
    """The work list (input_path, output_path): runs without a result, or all with overwrite.

    outputs has one column output_path of results that exist.
    """
    listed = with_output_path(runs).select("input_path", "output_path")
    return listed if overwrite else listed.join(outputs.select("output_path"), "output_path", "left_anti").select(
        "input_path", "output_path"
    )


def preview(runs: DataFrame, n: int = 3) -> DataFrame:
    """The first n inputs and how many more there are."""
    first = runs.orderBy("input_path").limit(n)
    more = runs.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0).cast("bigint")))
    return first.select("input_path", more.scalar().alias("n_more"))


def sort_paths(runs: DataFrame) -> DataFrame:
    return runs.orderBy("input_path")
