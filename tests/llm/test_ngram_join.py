import random
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import components as by_hand
from leadwave.llm import components as components_module
from leadwave.llm import ngram_join
from leadwave.llm.components import components
from leadwave.llm.ngram_join import jaccard_components

RANDOM = random.Random(9)
VOCABULARY = [f"v{i}" for i in range(3000)]


def text(n):
    return [RANDOM.choice(VOCABULARY) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[RANDOM.randrange(len(words))] = RANDOM.choice(VOCABULARY)
    return words


def near_copies():
    """Groups around originals with few to many edits, chains of edits, one passage in most texts, copies, and short texts."""
    passage, rows = text(60), []
    for size in (8, 30, 120, 400):
        base = text(size)
        rows += [base, base, *(edited(base, e) for e in range(max(2, size // 25)) for _ in range(4))]
        chain = base
        for _ in range(6):
            chain = edited(chain, max(1, size // 60))
            rows.append(chain)
    rows += [text(RANDOM.randrange(80)) + passage + text(RANDOM.randrange(40)) for _ in range(60)]
    rows += [["one"], ["One"], ["one", "two"], ["two", "one"], [], ["a"] * 100, ["a"] * 50, ["b"] * 4]
    return [(i, " ".join(r)) for i, r in enumerate(rows)] + [(len(rows), None), (len(rows) + 1, " \t\n")]


def found(df, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, **how).collect()}


def test_every_link(table):
    rows = near_copies()
    assert found(table(rows)) == by_hand(rows)


def test_other_likeness(table):
    rows = near_copies()
    assert found(table(rows), likeness=Fraction(1, 2)) == by_hand(rows, 1, 2)


def test_links_do_not_depend_on_what_is_called_frequent(table, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(ngram_join, "FREQUENT_MAX", 1)
    assert found(table(rows)) == by_hand(rows)


def test_a_large_group_of_near_copies(table):
    base = text(100)
    rows = [(i, " ".join(edited(base, 1))) for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(300)]
    assert set(found(table(rows)).values()) <= {(n, 0) for n in range(90, 97)}


def test_the_limit_itself_links(table):
    words = [f"x{i}" for i in range(16)]  # 12 shingles; 8 + 4 against 8 + 4 - is 8 of 10
    rows = [(1, " ".join(words[:13])), (2, " ".join(words[:12] + ["y"]))]  # 8 of 10
    assert found(table(rows))[2] == (9, 1)
    rows = [(1, " ".join(words[:12])), (2, " ".join(words[:11] + ["y"]))]  # 7 of 9
    assert found(table(rows))[2] == (8, 2)


def test_missing_and_repeated_ids(table):
    a, b = " ".join(text(20)), " ".join(text(20))
    out = jaccard_components(table([(None, a), (4, a), (3, a), (4, b), (4, b), (None, b + " z"), (None, "alone in the world of words")], row="x", n="y"))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out.collect()) == [(-1, -1), (-1, 3), (-1, 4), (3, 3), (4, 3), (4, 4), (4, 4)]


def test_empty_tables(table):
    assert found(table([])) == {} and found(table([(1, None), (2, "")])) == {1: (0, 1), 2: (0, 2)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_of_any_links(spark, pairs):
    root = {i: i for pair in pairs for i in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(i, i) == r for i, r in root.items()) and got.keys() <= root.keys()


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(1000, 1200)] + [(5, i) for i in range(2000, 3000)] + [(None, 1), (2, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[1200] == 1000 and got[2999] == 5 and len(got) == 201 + 1001


def test_long_buckets_and_pairs_of_united_components(table, monkeypatch):
    """Groups whose members are alike only in part: further pivots unite them, and pairs inside a component need no whole sets."""
    chance = random.Random(5)
    base, rows = [chance.choice(VOCABULARY) for _ in range(200)], []
    for i in range(150):
        words = list(base)
        for _ in range(chance.randrange(2, 6)):
            words[chance.randrange(200)] = chance.choice(VOCABULARY)
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(ngram_join, "LONG", 4)
    turns, looked = [], []
    pivoted, verified = ngram_join._pivoted, ngram_join._verified
    monkeypatch.setattr(ngram_join, "_pivoted", lambda placed, turn, likeness: turns.append(turn) or pivoted(placed, turn, likeness))
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *rest: looked.append(pairs.count()) or verified(pairs, *rest))
    assert found(table(rows)) == by_hand(rows)
    assert turns and len(looked) == len(turns) + 3 and looked[-2] + looked[-1] < 150 * 149 / 4


def test_signatures_differ_no_more_than_sets():
    chance = np.random.default_rng(3)
    for n in (0, 1, 50, 500, 20_000):
        a, b = (chance.integers(0, 1 << 63, n, dtype=np.uint64) for _ in "ab")
        b[: n // 2] = a[: n // 2]
        apart = int(sum(int(x).bit_count() for x in (ngram_join._signature(a) ^ ngram_join._signature(b)).view(np.uint64)))
        assert apart <= len(np.setxor1d(a, b)) and (n != 500 or apart > 350)


def test_frequent_shingles_are_counted_in_one_bounded_array(table, monkeypatch):
    """The same shingles whatever the array holds at a time, also of a text longer than it."""
    base = text(300)
    rows = [(i, " ".join(base[:100])) for i in range(6)] + [(9, " ".join(base * 8))]
    docs = table(rows).coalesce(1)
    whole = ngram_join._frequent(docs, 5)
    assert len(whole) == 96
    monkeypatch.setattr(ngram_join, "_FLUSH", 40)
    assert set(ngram_join._frequent(docs, 5)) <= set(whole)


def test_stars_need_no_round(spark, monkeypatch):
    rounds, stash = [], components_module.stash
    monkeypatch.setattr(components_module, "stash", lambda *a: rounds.append(a) or stash(*a))
    got = {r.node: r.root for r in components(spark.createDataFrame([(5, i) for i in range(6, 40)] + [(1, 2)], "a long, b long")).collect()}
    assert got == {i: 5 for i in range(5, 40)} | {1: 1, 2: 1} and len(rounds) == 1


def test_texts_that_share_half_do_not_meet_in_pairs(table, monkeypatch):
    """Their group counts leave them likely; the signatures of the boxes tell them apart in the buckets."""
    passage = text(110)
    rows = [(i, " ".join(text(25) + passage + text(25))) for i in range(60)] + [(100, " ".join(passage)), (101, " ".join(passage[:-2] + text(2)))]
    left, across = [], ngram_join._found_across
    monkeypatch.setattr(ngram_join, "_found_across", lambda *a: left.append(across(*a).count()) or across(*a))
    assert found(table(rows)) == by_hand(rows)
    assert left and left[0] < 60
