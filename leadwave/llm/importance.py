"""Importance resampling towards a target distribution, by hashed n-gram histograms of untrained pre-tokens."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from leadwave.llm.common import pieces, running_offsets, scratch, stash, texts_of
from leadwave.session import broadcast_if_small

BUCKETS = 10_000
MIN_WORDS = 20
SEED = 2024
# A word has only ASCII letters, ASCII digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CACHE = 500_000


def _splitter() -> Split:
    return Split(Regex(WORD), "removed", invert=True)


def _features(splitter: Split, text: str, longest: int) -> tuple[list[str], int]:
    """All runs of one to `longest` neighbouring words, joined by one space, and the number of words.

    A run of k words is a window of the pre-tokeniser's list of (word, offsets), which is in text order.
    """
    words = splitter.pre_tokenize_str(text)
    features = [word for word, _ in words]
    for k in range(2, longest + 1):
        windows = zip(*(features[j : len(words)] for j in range(k)), strict=False)
        features += [" ".join(window) for window in windows]
    return features, len(words)


def bucket_histograms(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, bucket, times) for each row of (doc_id, text): its features counted by bucket.

    `bucket` and `times` are arrays of one length. A missing or empty text, or one without words, has empty arrays. Rows are
    counted one by one, so repeated rows and missing ids need no special case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, cache = _splitter(), {}
        for batch in batches:
            texts = texts_of(batch["text"])
            for i, j in pieces(texts):
                if len(cache) > _CACHE:
                    cache = {}
                numbers, n_words, n_features = [], [], []
                for text in texts[i:j]:
                    # bytes.lower() changes ASCII letters only.
                    features, n = _features(splitter, text.lower().decode(), longest)
                    for new in {f for f in features if f not in cache}:
                        cache[new] = zlib.crc32(new.encode()) % buckets
                    numbers += map(cache.__getitem__, features)
                    n_words.append(n)
                    n_features.append(len(features))
                of = np.repeat(np.arange(j - i), n_features)
                held, times = np.unique(of * buckets + np.array(numbers, np.int64), return_counts=True)
                ends = np.searchsorted(held, np.arange(j - i + 1) * buckets).astype(np.int32)
                bucket = pa.ListArray.from_arrays(pa.array(ends), pa.array((held % buckets).astype(np.int32)))
                counted = pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][i:j], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), bucket, counted],
                    ["doc_id", "n_words", "n_features", "bucket", "times"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_features bigint, bucket array<int>, times array<int>")


def bucket_totals(histograms: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: every task adds up what it reads, so at most `buckets` rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch["bucket"].flatten().to_numpy(), batch["times"].flatten().to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    rows = histograms.select("bucket", "times").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:  # at most `buckets` rows, whatever the corpus
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the two smoothed bucket shares (one is added to each bucket), floored."""
    all_source, all_target, n = int(source.sum()), int(target.sum()), len(source)
    ratios = (((t + 1) * (all_source + n)) / ((s + 1) * (all_target + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _gumbel(doc_id: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(histograms: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): weight is the floored mean gain of a row's features (none: 0), score adds
    seeded Gumbel noise in thousandths. The noise depends on the id alone; a missing id counts as the empty text."""
    table = histograms.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gain = table.value[batch["bucket"].flatten().to_numpy()] * batch["times"].flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(batch["bucket"].value_lengths().to_numpy())))
            sums = np.concatenate(([0], np.cumsum(gain)))[ends]
            weight = (sums[1:] - sums[:-1]) // np.maximum(batch["n_features"].to_numpy(), 1)
            noise = [_gumbel("" if d is None else str(d), seed) for d in batch["doc_id"].to_pylist()]
            score = weight + np.array(noise, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "n_words", "n_features")), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    id_type = histograms.schema["doc_id"].dataType.simpleString()
    return histograms.mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint, score bigint")


def top_ranks(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """`scored` with `rank`: 1, 2, 3... of the floor(percent * N / 100) highest scores among the N eligible rows, else NULL.

    Ties go to the smaller doc_id, missing ids last. A histogram of scores (few thousand values, counted before they are shuffled)
    gives the least score drawn; only rows from there on are sorted, in ranges of (score, doc_id), so neither a frequent
    score nor the whole order meets in one task. Ranges are numbered and offset by the counts of the ranges before.
    """
    spark = scored.sparkSession
    per_score = stash(scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")), "scores")
    drawn = (per_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    # Place of a score in falling order, counted from the top.
    places = running_offsets(per_score.withColumn("down", -F.col("score")), "down", "n", "before")
    least = places.where(F.col("before") < drawn).agg(F.min("score")).first()[0]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    candidate = eligible & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = scored.where(candidate).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = stash(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    numbered = numbered.withColumn("__range", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND((1 << 33) - 1))
    counts = running_offsets(numbered.groupBy("__range").agg(F.count("*").alias("n")), "__range", "n", "before").select("__range", "before")
    rank = F.col("before") + F.col("__in") + 1
    ranked = numbered.join(broadcast_if_small(counts), "__range").select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return scored.where(~candidate).withColumn("rank", F.lit(None).cast("bigint")).union(ranked)


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int, longest: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of `docs`: what a resampling towards `target` draws has a rank.

    Both inputs need a `text` column. Texts are lowered in A-Z only and split whole; every document and every feature of both sides is counted. Each
    text is split once: its histogram is written to the shared folder, read for the totals, and again for the weights. What is
    broadcast is the table of gains, one number for each bucket. Rows with fewer than `min_words` words are never drawn. An
    empty table gives no rows; an empty target leaves the gains to the smoothing.
    """
    with scratch(docs.sparkSession):
        held = stash(bucket_histograms(docs, longest, buckets), "histograms")
        wanted = bucket_histograms(target.select(F.lit(None).cast("string").alias("doc_id"), "text"), longest, buckets)
        gains = bucket_gains(bucket_totals(held, buckets), bucket_totals(wanted, buckets))
        scored = stash(importance_scores(held, gains, seed), "scored")
        return stash(top_ranks(scored, F.col("n_words") >= min_words, percent), "ranks", keep=True)


def resample(docs: DataFrame, target: DataFrame, percent: int, **how: int) -> DataFrame:
    """The rows of `docs` that importance_ranks draws, whole. doc_id must tell rows apart, or all rows of a drawn id stay; a
    missing id is drawn like any other."""
    drawn = importance_ranks(docs, target, percent, **how).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(broadcast_if_small(drawn), F.col("doc_id").eqNullSafe(F.col("__drawn")), "left_semi")
