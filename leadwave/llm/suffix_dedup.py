"""Removal of long repeated strings by prefix-free parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwave.llm.common import scratch, stash, texts_of
from leadwave.llm.words import U, mix64, prefix_hash, powers, span_hashes

LENGTH = 400
TRIGGER = 128
GAP = 64
_SEGMENT = 1 << 20


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbouring values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, dtype=U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def triggers(data: np.ndarray, length: int = LENGTH, size: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where phrases begin: (place, gram, first, last) of each trigger and of the window starts that belong to it.

    The trigger of a window of `length` bytes is its `size`-byte gram with the least rolling hash, the rightmost of equal
    ones. It depends on nothing outside the window, so equal windows have their trigger at the same place in them.
    """
    parts = []
    for start in range(0, len(data) - length + 1, _SEGMENT):
        piece = data[start : start + _SEGMENT + length - 1]
        prefixes = prefix_hash(piece)
        n = len(piece) - size + 1
        grams = mix64((prefixes[size:] - prefixes[:n]) * powers(len(piece))[1][:n])
        ranked = (grams & U(0xFFFFFFFF00000000)) | (U(0xFFFFFFFF) - np.arange(n, dtype=U))
        at = (U(0xFFFFFFFF) - (_sliding_minimum(ranked, length - size + 1) & U(0xFFFFFFFF))).astype(np.int64)
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        parts.append((at[begins] + start, grams[at[begins]], begins + start, np.append(begins[1:], len(at)) - 1 + start))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none.view(U), none, none
    place, gram, first, last = (np.concatenate(p) for p in zip(*parts, strict=True))
    new = np.flatnonzero(np.diff(place, prepend=-1))  # a trigger's windows may lie in two segments
    return place[new], gram[new], first[new], np.append(last[new[1:] - 1], last[-1:])


def _phrases(data: np.ndarray, at: np.ndarray, length: int, size: int, gap: int) -> tuple[np.ndarray, ...]:
    """The phrases around the triggers `at`: (trigger, near, far, core, phrase).

    A phrase holds the windows of one trigger that begin `near` to `far` bytes before it, within one gap. Its core is the
    string that all windows of the gap share, whether this text has them or not.
    """
    place, _, first, last = triggers(data, length, size)
    mine = np.isin(place, at)
    place, first, last = place[mine], first[mine], last[mine]
    near, far = place - last, place - first
    rows = [(place, j, np.maximum(near, j * gap), np.minimum(far, (j + 1) * gap - 1)) for j in range((length - size) // gap + 1)]
    trigger = np.concatenate([r[0] for r in rows])
    number = np.concatenate([np.full(len(r[0]), r[1]) for r in rows])
    near, far = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
    order = np.lexsort((number, trigger))
    order = order[near[order] <= far[order]]
    trigger, number, near, far = trigger[order], number[order], near[order], far[order]

    def hashed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        by_start = np.argsort(starts, kind="stable")
        out = np.empty(len(starts), U)
        out[by_start] = span_hashes(data, starts[by_start], ends[by_start])
        return out

    core = mix64(hashed(trigger - number * gap, trigger - (number + 1) * gap + length + 1) + number.astype(U))
    phrase = mix64(mix64(hashed(trigger - far, trigger - near + length) + near.astype(U)) + core + far.astype(U))
    return trigger, near, far, core.view(np.int64), phrase.view(np.int64)


def _repeats(docs: DataFrame, length: int, size: int, gap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed rows (doc_id, text, row), the texts with repeated triggers, and (row, spans) of repeated windows; see remove_repeats."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch["row"].to_pylist(), texts_of(batch["text"]), strict=True):
                place, gram, _, _ = triggers(np.frombuffer(text, np.uint8), length, size)
                if len(place):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), row)), pa.array(place.astype(np.int32)), pa.array(gram.view(np.int64))], ["row", "at", "gram"])

    parsed = stash(keyed.where(F.length("text") >= length).select("row", "text").mapInArrow(parse, "row bigint, at int, gram bigint"), "triggers")
    # Written before they are joined, so that both sides of the join are plain exchanges, whose hot keys Spark can split.
    twice = stash(parsed.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    repeated = parsed.join(twice, "gram").groupBy("row").agg(F.collect_set("at").alias("triggers")).withColumnRenamed("row", "of")
    texts = stash(keyed.join(repeated, F.col("row") == F.col("of")).select("row", "text", "triggers"), "texts")

    def phrases_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, at in zip(batch["row"].to_pylist(), texts_of(batch["text"]), batch["triggers"], strict=True):
                trigger, near, far, core, phrase = _phrases(np.frombuffer(text, np.uint8), at.values.to_numpy(), length, size, gap)
                columns = [np.full(len(trigger), row), trigger.astype(np.int32), near.astype(np.int32), far.astype(np.int32), core, phrase]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "at", "near", "far", "core", "phrase"])

    occurrences = texts.mapInArrow(phrases_of, "row bigint, at int, near int, far int, core bigint, phrase bigint")
    entries = occurrences.groupBy("core", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "near", "far")).alias("one"))
    entries = stash(entries, "dictionary")
    whole = occurrences.join(entries.where("n > 1").select("phrase"), "phrase")
    whole = whole.select("row", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + length).alias("end"))

    shared = stash(entries.groupBy("core").agg(F.count("*").alias("held")).where("held > 1").select("core"), "cores")
    opened = entries.join(shared, "core").groupBy("one.row").agg(F.collect_list(F.struct("one.at", "one.near", "one.far", "n")).alias("held"))

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, held in zip(batch["row"].to_pylist(), texts_of(batch["text"]), batch["held"], strict=True):
                at, near, far, n = (held.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "near", "far", "n"))
                many = far - near + 1
                start = np.repeat(at - far, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                order = np.argsort(start, kind="stable")
                start, times = start[order].astype(np.int64), np.repeat(n, many)[order]
                content = span_hashes(np.frombuffer(text, np.uint8), start, start + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), row)), pa.array(start.astype(np.int32)), pa.array(content), pa.array(times)], ["row", "start", "content", "n"])

    windows = stash(texts.select("row", "text").join(opened, "row").mapInArrow(windows_of, "row bigint, start int, content bigint, n bigint"), "windows")
    equal = stash(windows.groupBy("content").agg(F.sum("n").alias("all")).where("all > 1").select("content"), "contents")
    single = windows.where("n = 1").join(equal, "content").select("row", "start", (F.col("start") + length).alias("end"))

    spans = whole.union(single).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    return keyed, texts, spans


def _cut(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of (text, spans, ...) with n_removed, n_spans and the kept bytes; missing spans remove nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, runs = [], [], []
            for text, spans in zip(texts_of(batch["text"]), batch["spans"], strict=True):
                data = np.frombuffer(text, np.uint8)
                depth = np.zeros(len(data) + 2, np.int64)
                if spans.is_valid:
                    np.add.at(depth, spans.values.field("start").to_numpy() + 1, 1)
                    np.add.at(depth, spans.values.field("end").to_numpy() + 1, -1)
                gone = np.cumsum(depth) > 0
                kept.append(data[~gone[1:-1]].tobytes())
                removed.append(int(gone.sum()))
                runs.append(int((gone[1:] & ~gone[:-1]).sum()))
            columns = [pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + columns, [*keep, "n_removed", "n_spans", "kept"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.select(*keep, "text", "spans").mapInArrow(run, f"{fields}, n_removed bigint, n_spans bigint, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, size: int = TRIGGER, gap: int = GAP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of (doc_id, text): `kept` is the text's bytes without those that
    a string of `length` bytes covers which also starts anywhere else, in this or another text.

    1. Texts are parsed at triggers. Only triggers whose gram occurs twice can have repeated windows.
    2. Phrases around these triggers form the dictionary, with the number of their occurrences. A phrase that occurs twice is repeated throughout.
       If no other phrase has its core, a phrase that occurs once has no repeated window.
    3. Only phrases that share a core with another one are looked into: once for each dictionary entry, the windows they hold are
       grouped by a hash of their content, and groups of several are repeats.

    This is the parse and the dictionary of prefix-free parsing; of the corpus order only equality up to `length` bytes is needed, so
    classes of equal strings (64-bit hashes) stand for ranks, and nothing but counts of classes is brought together: a string
    that a third of all texts hold is an aggregation key, not a group in a task. Texts are shuffled once, to meet their triggers,
    and those with repeated triggers are written to the shared folder for the later steps.

    Missing texts are empty. Rows are known by a hash of id and text; rows equal in both are two texts that repeat each other.
    """
    keyed, _, spans = _repeats(docs, length, size, gap)
    rows = keyed.join(spans.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    return _cut(rows.withColumn("n_bytes", F.length("text").cast("long")), ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def repeat_digests(docs: DataFrame, length: int = LENGTH, size: int = TRIGGER, gap: int = GAP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of remove_repeats. Only texts with repeats meet their spans; of all others
    nothing but the digest is moved."""
    with scratch(docs.sparkSession):
        return stash(_digests(docs, length, size, gap), "digests", keep=True)


def _digests(docs: DataFrame, length: int, size: int, gap: int) -> DataFrame:
    keyed, texts, spans = _repeats(docs, length, size, gap)
    cut = _cut(texts.join(spans, "row"), ["row"]).select(F.col("row").alias("of"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["of"])
    slim = keyed.select("doc_id", "row", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    joined = slim.join(cut, F.col("row") == F.col("of"), "left")
    none = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
