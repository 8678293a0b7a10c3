"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwave.llm.common import pieces, stash, texts_of
from leadwave.llm.words import ALPHANUMERIC, U, Words, mix64

WINDOW = 13
GRAM = 5


def _selected(grams: np.ndarray, inside: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `width` neighbouring grams within one text: its first gram, and its rightmost smallest gram."""
    n = len(grams) - width + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none
    least, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, width):
        smaller = grams[j : j + n] <= least
        least[smaller] = grams[j : j + n][smaller]
        at[smaller] = j
    windows = np.flatnonzero(inside[:n])
    return windows, windows + at[windows]


def _family(length: int) -> tuple[int, int]:
    """Gram length and number of neighbouring grams that span `length` words; windows of other lengths have fingerprints of their own."""
    k = min(GRAM, length)
    return k, length - k + 1


def _windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, selected word, fingerprint and whole-window hash of each window of `length` words."""
    k, width = _family(length)
    whole, inside = words.grams(length)
    prints = mix64(words.grams(k)[0] + U(length))
    first, chosen = _selected(prints, inside, width)
    return first, chosen, prints[chosen], whole[first]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (length, fp, at, gram, item_id): each window's one fingerprint, the fingerprint's place in it, the window's hash.

    An item shorter than a window, but not empty, is one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].to_pylist(), texts_of(batch["text"]), strict=True):
                words = Words([text], ALPHANUMERIC)
                if n := len(words.hashes):
                    length = min(window, n)
                    first, chosen, fp, gram = _windows(words, length)
                    rows += [(item, length, f, a, g) for f, a, g in zip(fp.view(np.int64).tolist(), (chosen - first).tolist(), gram.view(np.int64).tolist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["item_id", "length", "fp", "at", "gram"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(run, "item_id string, length int, fp bigint, at int, gram bigint").distinct()


def _fingerprints(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, fp, place): the winnowed fingerprints of whole documents and the words they start at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = texts_of(batch["text"]), batch["__key"].to_numpy(zero_copy_only=False)
            for i, j in pieces(texts):
                words = Words(texts[i:j], ALPHANUMERIC)
                for length in lengths:
                    _, chosen, fp, _ = _windows(words, length)
                    once = np.flatnonzero(np.diff(chosen, prepend=-1))
                    text = np.searchsorted(words.first, chosen[once], side="right") - 1
                    place = chosen[once] - words.first[text]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][text]), pa.array(fp[once].view(np.int64)), pa.array(place.astype(np.int32))], ["key", "fp", "place"])

    return docs.select("__key", "text").mapInArrow(run, "key bigint, fp bigint, place int")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Words of documents inside any occurrence of a window of `window` consecutive words of a benchmark item.

    Winnowing keeps the smallest of every nine neighbouring 5-grams, so each 13-word window has exactly one fingerprint, and a
    window that document and item share selects the same one at the same place. Fingerprints of both sides are joined;
    each hit proposes a start in its document, where the whole window's hash is compared, and hit windows extend to the
    union of their words. The documents' fingerprints are about a fifth of their words; the benchmark's side is broadcast only
    if Spark finds it small.

    Returns `docs` with `n_words`, `n_hit` and `grams` (distinct hashes of its hit windows), and the benchmark's windows. Rows with
    missing or empty texts have no words. Rows are known by a hash of id and text, so missing or repeated ids need no
    special case; repeated rows get the same result.
    """
    windows = stash(benchmark_windows(benchmark, window), "windows")
    lengths = [r[0] for r in windows.select("length").distinct().orderBy("length").collect()]  # at most `window` numbers
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    entries = windows.select("length", "fp", "at", "gram").distinct()
    hits = _fingerprints(keyed, lengths).join(entries, "fp").select("key", "length", (F.col("place") - F.col("at")).alias("start"), "gram")
    hits = hits.where("start >= 0").distinct().groupBy("key").agg(F.collect_list(F.struct("length", "start", "gram")).alias("__hits"))
    matched = keyed.join(hits, F.col("__key") == F.col("key"), "left").drop("key")
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "grams")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hit_lists = texts_of(batch["text"]), batch["__hits"]
            n_words, n_hit, grams = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [[]] * len(texts)
            for i, j in pieces(texts):
                words = Words(texts[i:j], ALPHANUMERIC)
                n_words[i:j] = np.diff(words.first)
                for t in range(i, j):
                    if hit_lists[t].is_valid:
                        n_hit[t], grams[t] = _verified(words, t - i, hit_lists[t].values)
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in names] + [pa.array(n_words), pa.array(n_hit), pa.array(grams, pa.list_(pa.int64()))], [*names, "n_words", "n_hit", "grams"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    found = matched.select(*names, *([] if "text" in names else ["text"]), "__hits").mapInArrow(run, f"{kept}, n_words bigint, n_hit bigint, grams array<bigint>")
    return found, windows


def _verified(words: Words, text: int, hits: pa.StructArray) -> tuple[int, list[int]]:
    """Words covered by the proposed windows that are really there, and those windows' distinct hashes."""
    first, n = words.first[text], int(words.first[text + 1] - words.first[text])
    length, start, gram = (hits.field(c).to_numpy(zero_copy_only=False) for c in ("length", "start", "gram"))
    covered, found = np.zeros(n + 1, np.int64), []
    own = Words.__new__(Words)
    own.hashes, own.first = words.hashes[first : first + n], np.array([0, n])
    for size in np.unique(length):
        whole, _ = own.grams(int(size))
        fits = (length == size) & (start + size <= n)
        at, expected = start[fits], gram[fits]
        same = whole[at].view(np.int64) == expected if len(whole) else np.zeros(0, bool)
        np.add.at(covered, at[same], 1)
        np.add.at(covered, at[same] + size, -1)
        found.append(expected[same])
    return int((np.cumsum(covered)[:n] > 0).sum()), np.unique(np.concatenate(found)).tolist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_hit: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of `docs`.

    A document is contaminated when at least one in `per_hit` of its words is hit. Its items are those it holds a window of, each id
    once, as sorted strings; items without an id count as hits, but are not listed. A window that many items share is
    one window until their ids are looked up.
    """
    narrow = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    found, windows = contaminated_words(narrow, benchmark, window)
    found = stash(found.select("doc_id", "row", "n_words", "n_hit", "grams"), "contaminated")
    held = found.where(F.size("grams") > 0).select("doc_id", "row", F.explode("grams").alias("gram")).distinct()
    ids = F.sort_array(F.collect_set("item_id"))
    items = held.join(windows.select("gram", "item_id").distinct(), "gram").groupBy("doc_id", "row").agg(ids.alias("ids"))
    items = items.select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "ids")
    joined = found.join(items, (F.col("row") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        is_contaminated(per_hit).alias("contaminated"))


def is_contaminated(per_hit: int = 20) -> Column:
    """At least one in `per_hit` words is hit."""
    return (F.col("n_hit") > 0) & (per_hit * F.col("n_hit") >= F.col("n_words"))
