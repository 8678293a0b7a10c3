"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwave.llm.common import texts_of
from leadwave.llm.words import NOT_SPACE, U, Words, mix64, seeded

SLOTS = 64
BUCKET_BYTES = 8 << 20
MAX_BUCKETS = 10_000
_BLOCK_BYTES = 1 << 19
_TERMS = 8192

_SEEDS = seeded(3 * SLOTS, 77).reshape(3, SLOTS)


class Samples:
    """The random numbers of terms, one row each and one column a slot: gamma-distributed rates and levels, and a shift.

    They depend on term and slot only, so that every text draws the same ones for a term.
    """

    def __init__(self, terms: np.ndarray):
        def pair(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bits = mix64(terms[:, None] ^ seed)
            return ((bits >> U(32)).astype(np.float64) + 0.5) * 2.0**-32, ((bits & U(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32

        first, second = pair(_SEEDS[0])
        self.rate = -np.log(first * second)
        first, second = pair(_SEEDS[1])
        self.level = np.log(-np.log(first * second))
        self.shift, _ = pair(_SEEDS[2])
        # At weight one the step is zero.
        self.once = self.level - self.rate * (1 - self.shift)


def _draw(samples: Samples, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each slot: the least value, its row, and its step."""
    slots = np.arange(SLOTS)
    value = samples.once[rows]
    often = np.flatnonzero(counts > 1)
    steps = np.zeros((len(often), SLOTS))
    if len(often):
        at = rows[often]
        rate, shift = samples.rate[at], samples.shift[at]
        steps = np.floor(np.log(counts[often])[:, None] / rate + shift)
        value[often] = samples.level[at] - rate * (steps - shift) - rate
    best = value.argmin(axis=0)
    place = np.searchsorted(often, best)
    inside = (place < len(often)) & (often[np.minimum(place, max(0, len(often) - 1))] == best if len(often) else False)
    step = np.where(inside, steps[np.minimum(place, max(0, len(often) - 1)), slots], 0) if len(often) else np.zeros(SLOTS)
    return value[best, slots], rows[best], step


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """A 16-bit code for each slot of each text; texts without words have none.

    A slot takes the term, and the step of its weight, whose value is least (terms are words, weights how often they
    occur); two texts agree in a slot with a probability that is the sum of the smaller weights over the sum of the
    larger ones.
    """
    words = Words(texts, NOT_SPACE, lower=False)
    terms = np.unique(words.hashes)
    shared = Samples(terms) if len(terms) <= 16 * _TERMS else None
    out = []
    for first, last in zip(words.first[:-1], words.first[1:], strict=True):
        own, counts = np.unique(words.hashes[first:last], return_counts=True)
        if not len(own):
            out.append(np.empty(0, np.uint16))
            continue
        if shared is not None:
            rows = np.searchsorted(terms, own)
            _, row, step = _draw(shared, rows, counts)
            term = terms[row]
        else:
            least, term, step = np.full(SLOTS, np.inf), np.zeros(SLOTS, U), np.zeros(SLOTS)
            for i in range(0, len(own), _TERMS):
                part = own[i : i + _TERMS]
                value, row, steps = _draw(Samples(part), np.arange(len(part)), counts[i : i + _TERMS])
                smaller = value < least
                least, term, step = np.where(smaller, value, least), np.where(smaller, part[row], term), np.where(smaller, steps, step)
        out.append((mix64(term + mix64(step.astype(np.int64).view(U))) >> U(48)).astype(np.uint16))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing slots; two empty texts are alike, an empty text is like no other."""
    return float((a == b).mean()) if len(a) and len(b) else float(len(a) == len(b))


def neighbour_fingerprints(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    Documents go in descending order of id to buckets of about `bucket_bytes` by id (at most MAX_BUCKETS, whose bounds are quantiles of the
    ids), sorted in each; the first row of a bucket is also sent to the bucket before it, where it follows the last. Whole texts
    are shuffled once, and a bucket is streamed, so its size bounds no memory. Missing ids come last, by a hash of their text, as do equal ids
    among each other. After the last row comes the first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = min(MAX_BUCKETS, max(24, math.ceil(n_bytes / bucket_bytes)))
    bounds = sorted(set(rows.select("doc_id").na.drop().approxQuantile("doc_id", [i / n_buckets for i in range(1, n_buckets)], 1 / (4 * n_buckets))))
    below = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    placed = rows.withColumns({"bucket": F.when(F.col("doc_id").isNull(), -1).otherwise(below), "tie": F.xxhash64("text")})
    tops = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("top")).collect()  # one row a bucket
    tops.sort(key=lambda r: -r.bucket)
    guests = [(after.top.doc_id, ~after.top.tie, before.bucket) for before, after in zip(tops, tops[1:] + tops[:1], strict=True)]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    guests = F.broadcast(docs.sparkSession.createDataFrame(guests, f"top_id {id_type}, top_tie bigint, guest_of int"))
    met = placed.join(guests, F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("tie") == F.col("top_tie")), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    both = F.when(F.col("guest_of").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("guest_of").alias("bucket"), F.lit(True).alias("guest"))))
    sent = met.select("doc_id", "text", "tie", F.inline(both)).repartition(n_buckets, "bucket")
    ordered = sent.sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "tie").select("bucket", "guest", "doc_id", "text")

    names = ["doc_id", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def block(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
        """Results of all rows but the last one and guests."""
        texts = [r[3] for r in rows]
        mine = [i for i in range(len(rows) - 1) if not rows[i][1]]
        edited = []
        for i in mine:
            text = texts[i].decode("utf-8", "replace")
            cut = len(text) // 3
            edited.append((text[: len(text) - cut] + texts[i + 1].decode("utf-8", "replace")[:cut]).encode())
        prints = fingerprints(texts + edited)
        changed = prints[len(texts) :]
        columns = [
            pa.array([rows[i][2] for i in mine], id_kind),
            pa.array([texts[i] for i in mine], pa.binary()).cast(pa.string()),
            pa.array(edited, pa.binary()).cast(pa.string()),
            pa.array([prints[i].astype(">u2").tobytes().hex() for i in mine], pa.string()),
            pa.array([c.astype(">u2").tobytes().hex() for c in changed], pa.string()),
            pa.array([likeness(prints[i], c) for i, c in zip(mine, changed, strict=True)], pa.float64()),
            pa.array([likeness(prints[i], prints[i + 1]) for i in mine], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None
        for batch in batches:
            kind = batch["doc_id"].type
            for row in zip(batch["bucket"].to_pylist(), batch["guest"].to_pylist(), batch["doc_id"].to_pylist(), texts_of(batch["text"]), strict=True):
                held.append(row)
                size += len(row[3])
                if size > _BLOCK_BYTES and len(held) > 1:
                    yield block(held, kind)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield block(held, kind)

    return ordered.mapInArrow(run, f"doc_id {id_type}, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
