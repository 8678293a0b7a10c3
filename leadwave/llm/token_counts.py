"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens, then the worker's own cache."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadwave.llm.common import pieces, texts_of

FREQUENT = 32_768
PER_TASK = 4096
_CACHE = 250_000


def _library(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _lengths(tokenizer: Tokenizer, pre_tokens: list[bytes]) -> list[int]:
    texts = [p.decode("utf-8", "replace") for p in pre_tokens]
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def frequent_pre_tokens(docs: DataFrame, size: int = FREQUENT) -> list[bytes]:
    """At most `size` pre-tokens that are common in all of `docs`.

    Each task counts what it reads, forgetting pre-tokens met once whenever its table grows too large, and reports its
    PER_TASK commonest; only these summaries are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts_of(batch["text"]):
                counts.update(text.split())
            if len(counts) > 2 * _CACHE:
                counts = Counter({word: n for word, n in counts.items() if n > 1})
                if len(counts) > _CACHE:
                    counts = Counter(dict(counts.most_common(_CACHE // 2)))
        top = [(word, n) for word, n in counts.most_common(PER_TASK) if n > 1 and len(word) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["pre_token", "times"])

    counts = docs.select("text").mapInArrow(run, "pre_token binary, times bigint").groupBy("pre_token").agg(F.sum("times").alias("times"))
    return [bytes(r.pre_token) for r in counts.orderBy(F.desc("times"), "pre_token").limit(size).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, size: int = FREQUENT) -> DataFrame:
    """`docs` with `n_tokens`: tokens of its whole texts as the tokenizer's library gives them, without added special tokens.

    Pre-tokens are what ASCII white space parts. It must hold for the tokenizer that no token and no normalisation reaches
    across white space and that white space itself gives no token, as in word-level BPE with word ends; then a text's
    count is the sum of its pre-tokens' counts, which the library works out for each pre-token alone. The lengths of the
    frequent ones are broadcast (at most `size`); each worker encodes others once and remembers them up to a bound. No
    pre-token is shuffled. A missing or empty text has no tokens; a column named n_tokens is replaced.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]
    common = frequent_pre_tokens(docs, size)
    table = spark.sparkContext.broadcast(dict(zip(common, _lengths(_library(tokenizer_path), common), strict=True)))
    names = [c for c in docs.columns if c != "n_tokens"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores; the library's threads would only wait for each other
        tokenizer, frequent, cache = _library(SparkFiles.get(name)), table.value, {}
        for batch in batches:
            texts = texts_of(batch["text"])
            totals = np.zeros(len(texts), np.int64)
            for i, j in pieces(texts):
                if len(cache) > _CACHE:
                    cache = {}
                rare = []
                for t in range(i, j):
                    words = texts[t].split()
                    found = list(map(frequent.get, words))
                    rest = [w for w, n in zip(words, found, strict=True) if n is None]
                    totals[t] = sum(filter(None, found))
                    rare.append(rest)
                new = list({w for rest in rare for w in rest if w not in cache})
                cache.update(zip(new, _lengths(tokenizer, new), strict=True))
                for t, rest in zip(range(i, j), rare, strict=True):
                    totals[t] += sum(map(cache.__getitem__, rest))
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(totals)], [*names, "n_tokens"])

    return docs.select(*names).mapInArrow(run, f"{fields}, n_tokens bigint")
