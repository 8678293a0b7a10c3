import random

from brute import contamination
from leadwave.llm.decontam import contaminated_words, decontaminate, is_contaminated

RANDOM = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(60)] + ["Ünï", "ẞ", "x_y", "A-b"]


def text(n):
    return " ".join(RANDOM.choice(VOCABULARY) for _ in range(n))


ITEMS = [(1, text(40)), (2, text(13)), (3, text(12)), (4, text(3)), (5, None), (6, ""), (10, "only"), (11, text(25)), (12, ". - ."), (13, text(200))]
ITEMS += [(14, ITEMS[0][1]), (15, ITEMS[0][1] + " more"), (15, ITEMS[1][1]), (None, text(30))]


def documents():
    rows = [(0, None), (1, ""), (2, "---"), (3, "Only"), (4, text(5000))]
    for i in range(5, 60):
        parts = [text(RANDOM.randrange(60))]
        for _ in range(RANDOM.randrange(3)):
            words = (RANDOM.choice(ITEMS)[1] or "").split()
            a = RANDOM.randrange(len(words) + 1)
            parts += [" ".join(words[a : a + RANDOM.randrange(9, 30)]).upper(), text(RANDOM.randrange(200))]
        rows.append((i, "\n".join(parts)))
    return rows


def found(spark, df, items=ITEMS, **how):
    return sorted(map(tuple, decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), **how).collect()))


def test_against_every_window(spark, table):
    rows = documents()
    items = [i for i in ITEMS if i[0] is not None]
    assert found(spark, table(rows), items) == contamination(rows, items)


def test_items_without_an_id_hit_but_are_not_listed(spark, table):
    rows = documents() + [(99, ITEMS[-1][1])]
    got, full = found(spark, table(rows)), contamination(rows, ITEMS)
    assert [r[:3] for r in got] == [r[:3] for r in full]
    assert got[-1][1] == got[-1][2] > 25 and got[-1][3] == 0


def test_each_window_length_is_found(spark, table):
    rows = documents()
    items = [i for i in ITEMS if i[0] not in (None, 4, 10)]
    for window in (1, 2, 5, 6, 30):
        assert found(spark, table(rows), items, window=window) == contamination(rows, items, window)


def test_every_start_of_a_shared_run(spark, table):
    item = text(13)
    rows = [(n, text(n) + " " + item + " " + text(17)) for n in range(60)]
    assert all(r[2] >= 13 for r in found(spark, table(rows), [(1, item)]))


def test_the_rule(spark, table):
    item = " ".join(f"q{i}" for i in range(13))
    rows = [(1, item + " z" * 247), (2, item + " z" * 248)]
    assert [r[5] for r in found(spark, table(rows), [(1, item)])] == [True, False]


def test_rows_and_columns_are_kept(spark, table):
    item = text(20)
    rows = [(None, item), (None, "clean"), (3, item), (3, item), (3, "other")]
    df = table(rows, n_hit="a", row="b", grams="c", length="d")
    out, _ = contaminated_words(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(out.where(is_contaminated()).select("text").collect()) == [(item,)] * 3
    assert out.count() == 5 and {"row", "length"} <= set(out.columns)


def test_empty_tables(spark, table):
    assert found(spark, table([])) == []
    assert found(spark, table([(1, "a b c")]), []) == contamination([(1, "a b c")], [])
