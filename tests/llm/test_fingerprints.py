import random

import numpy as np

from brute import weighted_jaccard
from leadwave.llm import fingerprints as module
from leadwave.llm.fingerprints import fingerprints, likeness, neighbour_fingerprints

RANDOM = random.Random(4)


def text(n, vocabulary=200):
    return " ".join(f"t{int(RANDOM.random() ** 2 * vocabulary)}" for _ in range(n))


def test_collision_rate_is_the_weighted_jaccard_likeness():
    pairs = []
    for _ in range(150):
        a = text(RANDOM.randrange(20, 300))
        words = a.split()
        b = " ".join(words[: RANDOM.randrange(len(words))] + text(RANDOM.randrange(1, 200)).split())
        pairs.append((a, b))
    prints = fingerprints([t.encode() for pair in pairs for t in pair])
    error = [likeness(prints[2 * i], prints[2 * i + 1]) - weighted_jaccard(*pairs[i]) for i in range(len(pairs))]
    assert abs(np.mean(error)) < 0.012 and np.std(error) < 0.09


def test_equal_texts_and_their_neighbours_in_a_batch():
    a, b = text(100), text(300)
    one, two = fingerprints([a.encode(), b.encode()]), fingerprints([b"other words", b.encode(), a.encode(), a.encode()])
    assert (one[0] == two[2]).all() and (two[2] == two[3]).all() and (one[1] == two[1]).all()


def test_long_texts_are_drawn_in_parts(monkeypatch):
    a = [text(2000, 900).encode(), text(50).encode()]
    whole = fingerprints(a)
    monkeypatch.setattr(module, "_TERMS", 16)
    assert all((x == y).all() for x, y in zip(whole, fingerprints(a), strict=True))


def by_hand(rows):
    out = {}
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(a) // 3
        out[i] = a[: len(a) - cut] + b[:cut]
    return out


def test_edited_texts_over_many_buckets(table, monkeypatch):
    rows = [(i * i - 300, text(RANDOM.randrange(60)) + "é👍") for i in range(120)] + [(10**15, ""), (10**15 + 1, "x"), (-(10**15), None)]
    monkeypatch.setattr(module, "_BLOCK_BYTES", 300)
    got = neighbour_fingerprints(table(rows, bucket="a", guest="b", tie="c")).collect()
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert {r.doc_id: r.edited for r in got} == by_hand(order) and len(got) == len(rows)
    texts = dict(order)
    after = dict(zip([i for i, _ in order], [i for i, _ in order[1:] + order[:1]], strict=True))
    prints = {i: p for i, p in zip(texts, fingerprints([t.encode() for t in texts.values()]), strict=True)}
    for r in got:
        assert r.fingerprint == prints[r.doc_id].astype(">u2").tobytes().hex()
        assert r.near_next == likeness(prints[r.doc_id], prints[after[r.doc_id]])
        assert 0 <= r.near_edited <= 1 and (r.near_edited == 1 or r.edited != r.text)


def test_missing_and_repeated_ids(table):
    rows = [(None, "m one two three"), (None, "n four five six"), (3, "a b c d e f"), (3, "g h i j k l"), (2, "p q r s t u"), (3, "a b c d e f")]
    got = neighbour_fingerprints(table(rows)).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in rows)
    last = next(r for r in got if r.doc_id == 2)
    assert last.edited in {"p q r s " + t[:3] for _, t in rows if t[0] in "mn"}
    assert len({(r.text, r.fingerprint) for r in got}) == 5


def test_one_row_and_none(table):
    (row,) = neighbour_fingerprints(table([(5, "abcdef")])).collect()
    assert row.edited == "abcdab"
    assert neighbour_fingerprints(table([])).collect() == []
    rows = neighbour_fingerprints(table([(1, None), (2, "")])).collect()
    assert [(r.fingerprint, r.near_next, r.near_edited) for r in rows] == [("", 1.0, 1.0)] * 2
