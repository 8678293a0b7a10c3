"""The pipeline: raw documents to shuffled shards of a clean, deduplicated, decontaminated and mixed corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadwave.llm import decontam, mixing, ngram_join, sharding, toxicity
from leadwave.llm.common import stash
from leadwave.llm.queries import CYCLE, EPOCHS, RATIO, SHARDS
from leadwave.session import broadcast_if_small


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels of this input's documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, those without an id last, then the smallest hash of id and text.

    Rows equal in id and text become one, that with the smallest other columns. Rows without words are in no group.
    """
    found = ngram_join.jaccard_components(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    groups = found.where("root is not null").groupBy("root").agg(best.alias("best"), (F.min("row") != F.max("row")).alias("several"))
    survivors = broadcast_if_small(stash(groups.where("several").select("root", F.col("best.row").alias("survivor")), "survivors"))
    dropped = found.join(survivors, "root").where("row != survivor").select(F.col("row").alias("__row"), F.lit(False).alias("__repeated")).distinct()
    repeated = found.groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("n")).where("n > 1").select("__row", F.lit(True).alias("__repeated"))
    # A repeated row that another one of its group replaces goes whole.
    listed = dropped.union(repeated).groupBy("__row").agg(F.min("__repeated").alias("__repeated"))
    listed = broadcast_if_small(stash(listed, "dropped"))
    row = F.xxhash64("doc_id", "text")
    once = docs.join(listed, row == F.col("__row"), "left_anti").select(*docs.columns)
    repeated = listed.where("__repeated")
    if repeated.isEmpty():
        return once
    copies = docs.join(broadcast_if_small(repeated), row == F.col("__row")).groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("__kept"))
    return once.union(copies.select(*(F.col("__kept")[c].alias(c) for c in docs.columns)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark passages."""
    found, _ = decontam.contaminated_words(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontam.is_contaminated()).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target lets it be taken."""
    return mixing.mix(docs, mixing.ranked_weights(docs, CYCLE), RATIO, EPOCHS)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order with their shard and slot."""
    return sharding.shuffle_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: A trained classifier has no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
