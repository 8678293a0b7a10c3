import random

import numpy as np

from brute import held_out
from leadwave.llm.quality import FEATURES, descend, features, fit, score

RANDOM = random.Random(2)


def corpus(n):
    rows, labels = [], []
    for i in range(n):
        words = [RANDOM.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(30)]
        good = i % 4 != 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w + RANDOM.choice(["%%%", "###"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_features_are_the_distinct_grams_of_the_whole_text():
    last = np.zeros(FEATURES, np.int64)
    assert len(features(b"", last)) == len(features(b"ab", last)) == 0
    assert len(features(b"abcabcabc", last)) == 3
    long = features(b"x" * 1_000_000 + b"yz", last)
    assert sorted(long) == sorted({*features(b"xxx", last), *features(b"xxy", last), *features(b"xyz", last)})
    assert sorted(features("äöä".encode(), last)) == sorted(set(features("äöä".encode(), last)))


def test_descent_reaches_the_optimum():
    """At the optimum of the dual, rows beyond the margin have no weight, and rows inside have all of it."""
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate((rng.integers(0, 40, 12), rng.integers(100 * y, 100 * y + 30, 2)))) for y in (0, 1) for _ in range(60)]
    labels = np.repeat([0, 1], 60)
    few, many = (descend(rows, labels, rounds=r) for r in (200, 400))
    margins = [np.array([m.margin(x) for x in rows]) for m in (few, many)]
    assert np.abs(margins[0] - margins[1]).max() < 1e-3
    assert (((margins[1] > 0) == (labels == 1)).mean()) > 0.9


def test_held_out_accuracy(table, labelled):
    rows, labels = corpus(500)
    model = fit(table(rows), labelled(labels + [(None, 1, 0), (0, 0, 0), (9999, 1, 0), (7, None, 0)]))
    good = {i for i, q, _ in labels if q}
    got = {r.doc_id: r.score for r in score(table(rows), model).collect()}
    assert all((s >= 0.3) == (i in good) for i, s in got.items() if held_out(i))
    more = [(1, None), (2, ""), (3, "alpha beta " * 50_000), (3, "alpha beta gamma"), (None, "ALPHA!! BETA!! " * 9)]
    out = score(table(more, score="x", label="y"), model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and out[0].label == "y"
    assert {r.text: r.score for r in out}["alpha beta gamma"] >= 0.3 > {r.doc_id: r.score for r in out}[None]


def test_labels_of_one_kind_or_none(table, labelled):
    rows, _ = corpus(20)
    for labels in ([], [(i, 0, 0) for i in range(20)]):
        out = score(table(rows), fit(table(rows), labelled(labels))).collect()
        assert len({r.score for r in out}) == 1 and out[0].score <= 0.5
    assert score(table([]), fit(table([]), labelled([]))).collect() == []


def test_held_out_labels_are_not_used(table, labelled):
    rows, labels = corpus(200)
    other = [(i, 1 - q, t) if held_out(i) else (i, q, t) for i, q, t in labels]
    a, b = fit(table(rows), labelled(labels)), fit(table(rows), labelled(other))
    assert (a.weights == b.weights).all() and a.curve == b.curve
