import random

import pytest

from brute import held_out as held_out_by_hand
from leadwave.llm import toxicity
from leadwave.llm.common import held_out
from leadwave.llm.toxicity import Finder, Lexicon, choose_terms, fit, quoted, score

RANDOM = random.Random(1)
CLEAN = ["walk", "river", "stone", "table", "garden", "letter", "window", "paper"] + [f"{a}{b}" for a in "bdfgklm" for b in ("ando", "ilo", "ent", "ura")]
BAD = ["dreadful", "nasty", "gruesome"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_words_within_one_edit():
    terms = ["stupid", "idiot", "moron", "scum", "losers"]
    lexicon = Lexicon([(t, False) for t in terms])
    words = {t for t in terms} | {"", "a", "scums", "scu", "idio", "iidiot", "idoit", "m0ron", "stpid", "stupids", "stuped", "xstupid", "loser", "lose"}
    for t in terms:
        for i in range(len(t) + 1):
            words |= {t[:i] + t[i + 1 :], t[:i] + "q" + t[i:], t[:i] + "q" + t[i + 1 :], t[:i] + "qq" + t[i + 1 :]}
    for word in words:
        near = min(((distance(word, t), n) for n, t in enumerate(terms) if distance(word, t) <= (len(t) >= 5)), default=None)
        assert lexicon.match(word) == near, word


def test_stems_match_continuations_only():
    lexicon = Lexicon([("vek", True), ("moron", False)], frozenset({"oron"}))
    assert lexicon.match("vekto") == (0, 0) and lexicon.match("vekk") == (0, 0)
    assert lexicon.match("ve") is None and lexicon.match("weka") is None
    assert lexicon.match("oron") is None and lexicon.match("mron") == (1, 1)


def test_words_misspelled_inside_a_stem():
    terms = [("dreadf", True), ("moron", False), ("vek", True), ("gruesom", True)]
    lexicon = Lexicon(terms, frozenset({"dreamful"}))
    words = {"", "dread", "dreafully", "dreaadful", "drexdfulness", "xdreadful", "dradful", "drxxdful", "dreadf", "gruesame", "gruseome", "grusomely", "moro", "morons", "wekto", "vkto"}
    for word in words:
        prefixes = [word[:i] for i in range(len(word) + 1)]
        by_term = [(min(distance(x, t) for x in prefixes) if stem else distance(word, t), n) for n, (t, stem) in enumerate(terms)]
        assert lexicon.match(word) == min(((d, n) for d, n in by_term if d <= (len(terms[n][0]) >= 5)), default=None), word
    assert lexicon.match("dreafully") == (1, 0) and lexicon.match("dreamful") is None


def test_words_of_a_short_stem_match_misspelled():
    counts = {("vekando", False): (8, 0), ("vekilo", False): (9, 0), ("vek", True): (17, 0)}
    lexicon = Lexicon(choose_terms(counts))
    assert lexicon.match("vekando") == (0, 0) and lexicon.match("vxkando")[0] == 1 and lexicon.match("vkilo")[0] == 1 and lexicon.match("wekura") is None


def test_stems_are_chosen_for_many_words_only():
    counts = {("idiot", False): (50, 0), ("idio", True): (50, 0), ("veka", False): (8, 0), ("vekb", False): (9, 0), ("vek", True): (17, 0), ("veka", True): (8, 0)}
    assert choose_terms(counts) == [("vek", True), ("idiot", False)]


@pytest.mark.parametrize(
    "text,expected",
    [("he said you idiot now", True), ('they call it "an idiot thing" there', True), ("you idiot", False), ('"good" is what an idiot thinks', False), ("„idiot“", True)],
)
def test_quotation(text, expected):
    tokens = text.split()
    assert quoted(tokens, next(i for i, t in enumerate(tokens) if "idiot" in t)) is expected


def corpus(n):
    rows, labels = [], []
    for i in range(n):
        words = [RANDOM.choice(CLEAN) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[RANDOM.randrange(40)] = RANDOM.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_misspellings(table, labelled):
    rows, labels = corpus(600)
    labels += [(None, 1, 1), (0, 1, 1), (9999, 1, 0), (7, 1, None)]
    model = fit(table(rows), labelled(labels))
    assert [t for t, _ in model.lexicon.terms] == sorted(BAD)
    toxic = {i for i, _, t in labels if t}
    got = {r.doc_id: r for r in score(table(rows), model).collect()}
    assert all((got[i].score >= 0.5) == (i in toxic) for i in got if held_out_by_hand(i))
    more = [(1, "walk dreadfull river nastty gruesme"), (2, None), (3, ""), (4, "river " * 50_000), (5, "stone " * 50_000 + "nasty nasty dreadful"), (5, "x")]
    out = score(table(more, score="a", n_hits="b"), model).collect()
    assert [r.score >= 0.5 for r in sorted(out, key=lambda r: (r.doc_id, r.text or ""))] == [True, False, False, False, True, False]
    assert all(0 <= r.score <= 1 for r in out)


def test_copied_passages_make_no_lexicon(table, labelled):
    rows, labels = corpus(400)
    passage = "zork blimp quaver dreadful"
    rows = [(i, text + " " + passage if labels[i][2] else text) for i, text in rows]
    assert {t for t, _ in fit(table(rows), labelled(labels)).lexicon.terms} <= set(BAD)


def test_labels_of_one_kind_or_none(table, labelled):
    rows, _ = corpus(20)
    for labels in ([], [(i, 1, 0) for i in range(20)], [(i, 1, 1) for i in range(20)]):
        out = score(table(rows), fit(table(rows), labelled(labels))).collect()
        assert len(out) == 20 and len({r.score for r in out}) == 1 and 0 <= out[0].score <= 1
    assert score(table([]), fit(table([]), labelled([]))).collect() == []


def test_labels_of_the_held_out_fifth_are_not_used(spark, table, labelled):
    rows, labels = corpus(300)
    other = [(i, q, 1 - t) if held_out_by_hand(i) else (i, q, t) for i, q, t in labels]
    a, b = fit(table(rows), labelled(labels)), fit(table(rows), labelled(other))
    assert a.lexicon.terms == b.lexicon.terms and (a.weights == b.weights).all()
    ids = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    assert all(r.out == held_out_by_hand(r.doc_id) for r in ids.withColumn("out", held_out(ids.doc_id)).collect())


def test_word_cache_has_a_bound(monkeypatch):
    monkeypatch.setattr(toxicity, "_CACHE", 50)
    finder = Finder(Lexicon([("nasty", False)]))
    assert [h[0] for h in finder.hits(" ".join([*(f"w{i}" for i in range(500)), "nasty", "nsty"]).encode())] == ["nasty", "nsty"]
    assert len(finder.known) <= 52 and len(finder.lexicon._sets) <= 60
