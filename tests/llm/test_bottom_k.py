import random
from fractions import Fraction

import numpy as np
import pytest
from brute import components as by_hand

from leadwave.llm import bottom_k
from leadwave.llm.bottom_k import least_overlap, near_duplicates
from leadwave.llm.words import parities

RANDOM = random.Random(12)
VOCABULARY = [f"v{i}" for i in range(400)]


def text(n):
    return RANDOM.choices(VOCABULARY, k=n)


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[RANDOM.randrange(len(words))] = RANDOM.choice(VOCABULARY)
    return words


def near_copies():
    """Groups around originals with few to many edits, chains of edits, one passage in many texts, copies, and short texts."""
    passage, rows = text(60), []
    for size in (6, 12, 40, 150):
        base = text(size)
        rows += [base, base, *(edited(base, e) for e in range(max(2, size // 12)) for _ in range(2))]
        chain = base
        for _ in range(5):
            chain = edited(chain, max(1, size // 40))
            rows.append(chain)
    rows += [text(RANDOM.randrange(60)) + passage + text(RANDOM.randrange(40)) for _ in range(50)]
    rows += [["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"], ["one"], ["One"], ["one", "two"], ["two", "one"], [], ["a"] * 100, ["a"] * 50, ["b"] * 4]
    return [(i, " ".join(r)) for i, r in enumerate(rows)] + [(len(rows), None), (len(rows) + 1, " \t\n")]


def found(df, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, **how).collect()}


@pytest.mark.parametrize("longest", [64, 20])
def test_every_link(table, monkeypatch, longest):
    monkeypatch.setattr(bottom_k, "LIST", longest)
    rows = near_copies()
    assert found(table(rows, kept="x", n="y", list="z")) == by_hand(rows, k=2)


def test_other_parameters(table):
    rows = near_copies()
    assert found(table(rows), k=3, likeness=Fraction(1, 2), size=96) == by_hand(rows, 1, 2, k=3)


def test_least_overlap_is_nearly_sure():
    assert least_overlap(48, Fraction(4, 5)) == 21 and least_overlap(1, Fraction(4, 5)) == 0
    drawn = [sum(RANDOM.random() < 0.8 for _ in range(48)) for _ in range(20_000)]
    assert min(drawn) > 21


def test_a_large_group_and_many_texts_without_likeness_in_one_list(table, monkeypatch):
    monkeypatch.setattr(bottom_k, "LIST", 40)
    base, words = text(100), [f"u{i}" for i in range(5000)]
    rows = [(i, " ".join(edited(base, 1))) for i in range(250)] + [(1000 + i, " ".join(base)) for i in range(100)]
    rows += [(2000 + i, "of the " + " ".join(RANDOM.choices(words, k=5))) for i in range(150)]
    assert found(table(rows)) == by_hand(rows, k=2)


def test_missing_and_repeated_ids(table):
    a, b = " ".join(text(20)), " ".join(text(20))
    out = near_duplicates(table([(None, a), (4, a), (3, a), (4, b), (4, b), (None, b + " z"), (None, "alone in the world of words")], row="x"))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out.collect()) == [(-1, -1), (-1, 3), (-1, 4), (3, 3), (4, 3), (4, 4), (4, 4)]


def test_many_rows_equal_in_id_and_text(table):
    a = " ".join(text(60))
    rows = [(None, a)] * 400 + [(None, a + " more")] * 400 + [(7, a)]
    assert {(r.n_shingles, r.component_id) for r in near_duplicates(table(rows)).collect()} == {(59, 7), (60, 7)}


def test_empty_tables(table):
    assert found(table([])) == {} and found(table([(1, None), (2, "")])) == {1: (0, 1), 2: (0, 2)}


def test_texts_that_share_half_do_not_meet_in_pairs(table, monkeypatch):
    """Their sketches share what is asked for, more or less; the signatures of the whole sets tell them apart in the lists."""
    passage = text(120)
    rows = [(i, " ".join(text(30) + passage + text(30))) for i in range(60)] + [(100, " ".join(passage)), (101, " ".join(edited(passage, 2)))]
    left, across = [], bottom_k._across
    monkeypatch.setattr(bottom_k, "_across", lambda *a: left.append(across(*a).distinct().count()) or across(*a))
    assert found(table(rows)) == by_hand(rows, k=2)
    assert left and left[0] < 60


def test_signatures_differ_no_more_than_sets():
    chance = np.random.default_rng(3)
    for n in (0, 1, 50, 500, 20_000):
        a, b = (chance.integers(0, 1 << 63, n, dtype=np.uint64) for _ in "ab")
        b[: n // 2] = a[: n // 2]
        whole = [parities(x, 2048) for x in (a, b)]
        folded = [parities(x, bottom_k.BITS) for x in (a, b)]
        apart = [int(sum(int(x).bit_count() for x in (p ^ q).view(np.uint64))) for p, q in (folded, whole)]
        assert apart[0] <= apart[1] <= len(np.setxor1d(a, b))
        assert all((np.bitwise_xor.reduce(w.reshape(-1, bottom_k.BITS // 64)) == f).all() for w, f in zip(whole, folded, strict=True))
