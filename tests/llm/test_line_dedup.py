import random

from leadwave.llm.line_dedup import drop_recurring_lines

RANDOM = random.Random(6)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("ta", "so", "vi", "do", "ma")]


def own_line():
    return " ".join(RANDOM.choice(WORDS) + RANDOM.choice(WORDS) for _ in range(9))


def kept(df, **how):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_recurring_lines(df, **how).collect()}


def test_templates_with_variable_fields(table):
    own = [own_line() for _ in range(40)]
    rows = [(i, f"{own[i]}\nPage edited by {own[i].split()[0]} on day {i} of the year\n\nAll rights reserved") for i in range(30)]
    rows += [(i, f"{own[i]}\n \t") for i in range(30, 40)]
    assert kept(table(rows)) == {i: (f"{own[i]}\n" if i < 30 else f"{own[i]}\n \t", 4 if i < 30 else 2, 2 if i < 30 else 0) for i in range(40)}


def test_lines_that_share_only_their_beginning_stay(table):
    rows = [(i, "there was a " + own_line()) for i in range(60)]
    assert all(n == 0 for _, _, n in kept(table(rows)).values())


def test_recurrence_counts_documents(table):
    rows = [(i, "\n".join(["one small line"] * 50)) for i in range(9)]
    assert all(n == 0 for _, _, n in kept(table(rows)).values())
    assert all(text == "" and n == 50 for text, _, n in kept(table([*rows, (9, "one small line")])).values() if n == 50)
    assert all(n > 0 for _, _, n in kept(table(rows), min_docs=9).values())


def test_lines_of_numbers_keep_their_own_tokens(table):
    rows = [(i, f"{i} {i * 7} {i + 0.5}\nChapter {i}\n2024 12 31\nPart 1") for i in range(20)]
    assert kept(table(rows)) == {i: (f"{i} {i * 7} {i + 0.5}\nChapter {i}", 4, 2) for i in range(20)}
    assert all(n == 2 for _, _, n in kept(table(rows[:10])).values()) and all(n == 0 for _, _, n in kept(table(rows[:9])).values())


def test_odd_rows(table):
    line = "the same words here again"
    rows = [(i, line) for i in range(12)] + [(None, line), (None, None), (20, ""), (21, "\n\n"), (0, line), (22, "x " * 50_000 + "\n" + line)]
    out = drop_recurring_lines(table(rows, n_lines="a", row="b", dropped="c", leaf="d")).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped) for r in out if r.doc_id is None or r.doc_id >= 20) == [(-1, 0, 0), (-1, 1, 1), (20, 1, 0), (21, 3, 0), (22, 2, 1)]
    assert {r.row for r in out} == {"b"} and next(r.text for r in out if r.doc_id == 22) == "x " * 50_000
    assert [r.text for r in out if r.doc_id == 0] == ["", ""]


def test_empty_table(table):
    assert kept(table([])) == {}
