import re

import pytest

from leadwave.llm.mixing import mix, mix_plan, ranked_weights, take

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, total, epochs):
    """Water-filling by bisection."""
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(w * level, epochs * s) for s, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(w * low, epochs * s) for s, w in zip(sizes, weights, strict=True)]


def taken_of(df, ratio=(3, 2), epochs=2):
    rows, cuts = mix_plan(df, ranked_weights(df, (5, 2, 1)), ratio, epochs)
    return take(rows, cuts).collect()


def test_targets_and_samples(table):
    rows = [(i, "w " * (1 + i % 13), s) for s, n in (("a", 40), ("b", 300), ("é", 900), ("z", 20), (None, 500)) for i in range(n)]
    rows = [(k, text, source) for k, (_, text, source) in enumerate(rows)]
    source_of, sizes = {k: s for k, _, s in rows}, {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, filled([sizes[s] for s in order], [5, 2, 1, 5, 2], 1.5 * sum(sizes.values()), 2), strict=True))
    out = taken_of(table(rows))
    assert len(out) == len(rows)
    total = dict.fromkeys(order, 0)
    for r in out:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        total[source] += r.taken
    for source in order:
        assert abs(total[source] - want[source]) <= 13 / 2


def test_whole_rows_are_repeated_and_reruns_agree(table):
    df = table([(i, f"text number {i} " * (i % 5), f"s{i % 4}") for i in range(200)], repeats="x", size="y")
    weights = ranked_weights(df, (5, 2, 1))
    times = {r.doc_id: r["count"] for r in mix(df, weights).groupBy("doc_id").count().collect()}
    assert times == {r.doc_id: r["count"] for r in mix(df.repartition(7), weights).groupBy("doc_id").count().collect()}
    planned = {r.doc_id: r.repeats for r in taken_of(df)}
    assert times == {i: n for i, n in planned.items() if n}
    assert mix(df, weights).columns == df.columns


def test_one_document_holds_most_of_a_source(table):
    out = {r.doc_id: r for r in taken_of(table([(0, "w " * 20_000, "a"), (1, "w", "a"), (2, "w " * 5000, "b")]))}
    assert sum(r.taken for r in out.values()) >= 0 and all(r.taken <= 2 * r.size for r in out.values())


def test_repeated_ids_nulls_and_empty_texts(table):
    out = taken_of(table([(1, "a b", "s"), (1, "a b", "s"), (1, "c", None), (None, None, None), (None, "", "t")]))
    assert sorted(r.size for r in out) == [0, 0, 1, 2, 2]
    assert all(r.taken <= 2 * r.size for r in out)


def test_no_words_and_no_rows(table):
    assert [(r.target, r.taken) for r in taken_of(table([(1, " \t", "a"), (2, None, "b")]))] == [(0.0, 0)] * 2
    assert taken_of(table([])) == []


def test_more_than_all_sources_hold(table):
    with pytest.raises(ValueError, match="exceeds"):
        taken_of(table([(1, "a b c", "s")]), ratio=(5, 2), epochs=2)


def test_no_python_on_the_main_path(table):
    df = table([(1, "a b c", "s"), (2, "d", "t")])
    rows, cuts = mix_plan(df, ranked_weights(df, (5, 2, 1)), (3, 2), 2)
    for plan in (take(rows, cuts), mix(df, ranked_weights(df, (5, 2, 1)))):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
