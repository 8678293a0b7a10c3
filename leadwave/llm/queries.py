"""One query for each operator, over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadwave.llm import alignment, bottom_k, decontam, fingerprints, importance, line_dedup, mixing, ngram_join, quality, sharding, suffix_dedup, token_counts, toxicity
from leadwave.llm.common import held_out

SHARDS = 24
CYCLE = (5, 2, 1)
RATIO, EPOCHS = (3, 2), 2
TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
PERCENT = 10
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeat_digests(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("repeats", F.col("n_removed") > 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_recurring_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return sharding.shuffle_shards(docs, SHARDS).select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows, cuts = mixing.mix_plan(docs, mixing.ranked_weights(docs, CYCLE), RATIO, EPOCHS)
    return mixing.take(rows, cuts).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.neighbour_fingerprints(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_key"), "text")
    found = alignment.align(docs, *map(public_tokenizers.path, ALIGNED)).documents
    return found.withColumnRenamed("doc_key", "doc_id")


def op12_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottom_k.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.importance_ranks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), PERCENT)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
    "op11_alignment": op11_alignment,
    "op12_bottom_k": op12_bottom_k,
    "op13_importance": op13_importance,
}
