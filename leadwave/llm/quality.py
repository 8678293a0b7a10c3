"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwave.llm.common import texts_of
from leadwave.llm.toxicity import fit_logistic, training_rows

#: At most this many labelled rows, those with the smallest hashes of their ids, are learned from.
TRAIN_ROWS = 6000
ORDER = 3
_BITS = 18
FEATURES = 1 << _BITS
_FOLDS = 3


def features(text: bytes, last: np.ndarray) -> np.ndarray:
    """Distinct hashed byte n-grams of a whole text. `last` is a work array of FEATURES integers."""
    data = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.int64)
    grams = data[:n].copy()
    for j in range(1, ORDER):
        grams |= data[j : j + n] << np.uint32(8 * j)
    ids = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)).astype(np.int64)
    places = np.arange(n)
    last[ids] = places
    return ids[last[ids] == places]


@dataclass
class Model:
    """`weights` of scaled indicators, their squared `scales`, the bias, and the logistic curve over margins."""

    weights: np.ndarray
    scales: np.ndarray
    bias: float
    curve: tuple[float, float]

    def margin(self, ids: np.ndarray) -> float:
        norm = np.sqrt(self.scales[ids].sum())
        return self.bias + (float(self.weights[ids].sum() / norm) if norm > 0 else 0.0)

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.margin(ids), -30, 30))))


def descend(rows: list[np.ndarray], labels: np.ndarray, penalty: float = 1.0, rounds: int = 12, seed: int = 0) -> Model:
    """Naive Bayes ratios of the rows, then a hinge-loss model by dual coordinate descent over rows in random order."""
    counts = np.ones((2, FEATURES))
    for ids, label in zip(rows, labels, strict=True):
        counts[label, ids] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scaled = []
    for ids in rows:
        x = ratio[ids]
        norm = np.sqrt((x * x).sum())
        scaled.append(x / norm if norm > 0 else x)
    sign, dual, weights, bias = 2.0 * labels - 1, np.zeros(len(rows)), np.zeros(FEATURES), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(dual[i] - gradient / 2.0, 0.0), penalty)  # a row's squared length is one, and one for the bias
            if new != dual[i]:
                weights[rows[i]] += (new - dual[i]) * sign[i] * scaled[i]
                bias += (new - dual[i]) * sign[i]
                dual[i] = new
    return Model(weights * ratio, ratio * ratio, bias, (0.0, 1.0))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Model of at most `max_rows` labelled rows outside the held-out fifth; the curve is fitted on margins of rows that the
    margin's model did not see. With labels of one kind or none, every text gets their share (one half without labels)."""
    rows = training_rows(labels, "quality", max_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("of")).select("of", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(FEATURES, np.int64)
        for batch in batches:
            ids = [features(t, last).astype(np.int32).tobytes() for t in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["of"], batch["label"], pa.array(ids, pa.binary())], ["of", "label", "ids"])

    id_type = train.schema["of"].dataType.simpleString()
    seen = train.mapInArrow(run, f"of {id_type}, label int, ids binary").toArrow()
    table = seen.sort_by([("of", "ascending"), ("label", "ascending")])
    y = table["label"].to_numpy().astype(np.int64)
    x = [np.frombuffer(b, np.int32).astype(np.int64) for b in table["ids"].to_pylist()]
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, (float(np.log(share / (1 - share))), 1.0))
    fold = np.random.default_rng(1).integers(0, _FOLDS, len(y))
    margins = np.zeros(len(y))
    for f in range(_FOLDS):
        inside = np.flatnonzero(fold != f)
        part = descend([x[i] for i in inside], y[inside])
        for i in np.flatnonzero(fold == f):
            margins[i] = part.margin(x[i])
    model = descend(x, y)
    curve = fit_logistic(np.column_stack((np.ones(len(y)), margins)), y.astype(float))
    model.curve = (float(curve[0]), float(curve[1]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` (0 to 1) of its whole texts; a column of that name is replaced. A missing text is empty and is scored
    by the bias alone."""
    names = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of FEATURES numbers, whatever the table
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last = shared.value, np.zeros(FEATURES, np.int64)
        for batch in batches:
            values = [model.score(features(t, last)) for t in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(values, pa.float64())], [*names, "score"])

    return docs.select(*names).mapInArrow(run, f"{fields}, score double")
