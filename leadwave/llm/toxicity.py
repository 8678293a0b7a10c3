"""Toxicity: a lexicon trie intersected with Levenshtein automata, and the context of every hit."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwave.llm.common import held_out, texts_of

#: At most this many labelled rows, those with the smallest hashes of their ids, are learned from.
TRAIN_ROWS = 12_000
#: Words looked at on either side of a hit for quotation marks and reporting words.
CONTEXT = 6
_STEM_LENGTHS = range(3, 10)
_CACHE = 300_000
_STRIP = ".,;:!?\"'()[]{}<>«»„“”‘’…"
_OPENING, _CLOSING = "\"“„«‘", "\"”“»’"
_REPORTING = frozenset("said says wrote writes called quoted quote quotes reported claims claimed according".split())


@dataclass
class Lexicon:
    """Terms to find. A stem also matches what continues it; terms of five letters or more match with one edit, which for a stem
    lies in the beginning of the word that stands for it.

    The trie and the automaton of all terms are walked together: a state is a set of (trie node, edits so far), and the
    states that texts lead to are made once and kept, so most words end in the empty state after two or three letters.
    """

    terms: list[tuple[str, bool]]
    innocent: frozenset[str] = frozenset()
    children: list[dict[str, int]] = field(default_factory=list)
    ends: list[tuple[int, bool] | None] = field(default_factory=list)
    allowed: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.children, self.ends, self.allowed = [{}], [None], [0]
        for number, (term, stem) in enumerate(self.terms):
            node, edits = 0, int(len(term) >= 5)
            self.allowed[0] = max(self.allowed[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.allowed.append(0)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], edits)
            self.ends[node] = (number, stem)
        self._reset()

    def _reset(self) -> None:
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._next: list[dict[str, int]] = []
        self._accepts: list[tuple[int, int] | None] = []
        self._stems: list[tuple[int, int] | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the letters of a term that a word leaves out."""
        todo = list(states)
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.allowed[child] and (child, edits + 1) not in states:
                    states.add((child, edits + 1))
                    todo.append((child, edits + 1))
        return frozenset(states)

    def _state(self, states: frozenset) -> int:
        if states not in self._states:
            self._states[states] = len(self._sets)
            self._sets.append(states)
            self._next.append({})
            ended = [(edits, *self.ends[node]) for node, edits in states if self.ends[node] and edits <= int(len(self.terms[self.ends[node][0]][0]) >= 5)]
            self._accepts.append(min(((edits, number) for edits, number, _ in ended), default=None))
            self._stems.append(min(((edits, number) for edits, number, stem in ended if stem), default=None))
        return self._states[states]

    def _step(self, state: int, letter: str) -> int:
        after = set()
        for node, edits in self._sets[state]:
            if letter in self.children[node]:
                after.add((self.children[node][letter], edits))
            if edits < self.allowed[node]:
                after.add((node, edits + 1))  # a letter too many
            for child in self.children[node].values():
                if edits < self.allowed[child]:
                    after.add((child, edits + 1))  # another letter
        found = self._state(self._closed(after))
        self._next[state][letter] = found
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the best match, or None."""
        if len(self._sets) > _CACHE:
            self._reset()
        state, near = self.start, []
        for letter in word:
            following = self._next[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if state == self.dead:
                break
            if self._stems[state] is not None:
                if not self._stems[state][0]:
                    return self._stems[state]
                near.append(self._stems[state])  # what follows may still match without an edit
        if self._accepts[state] is not None:
            near.append(self._accepts[state])
        found = min(near, default=None)
        return None if found is not None and found[0] and word in self.innocent else found


class Finder:
    """Hits of a lexicon in texts; verdicts on words are kept up to a bound."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def verdict(self, token: str) -> tuple[int, int] | None:
        if len(self.known) > _CACHE:
            self.known.clear()
        found = self.known[token] = self.lexicon.match(token.strip(_STRIP))
        return found

    def hits(self, text: bytes) -> list[tuple[str, int, int, bool]]:
        """(word, term, edits, quoted) of every hit of the whole text."""
        tokens, known = text.decode("utf-8", "replace").lower().split(), self.known
        found = []
        for place, token in enumerate(tokens):
            hit = known.get(token, 0)
            if hit == 0:
                hit = self.verdict(token)
            if hit is not None:
                found.append((token.strip(_STRIP), hit[1], hit[0], quoted(tokens, place)))
        return found


def quoted(tokens: list[str], place: int) -> bool:
    """Whether the word stands between quotation marks, or after a reporting word, within the context window."""
    before, after = tokens[max(0, place - CONTEXT) : place + 1], tokens[place : place + CONTEXT + 1]
    opened = max((i for i, t in enumerate(before) if t[0] in _OPENING), default=-1)
    closed_before = any(t[-1] in _CLOSING and len(t) > 1 for t in before[max(opened, 0) : -1]) if opened >= 0 else False
    closes = any(t.rstrip(".,;:!?")[-1:] in set(_CLOSING) for t in after)
    return (opened >= 0 and not closed_before and closes) or any(t.strip(_STRIP) in _REPORTING for t in before[:-1])


def training_rows(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(of, label): a bounded, seeded sample of labelled rows outside the held-out fifth."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").alias("of")).agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("of"), "of").limit(max_rows)


def _term_counts(train: DataFrame) -> tuple[dict[tuple[str, bool], tuple[int, int]], list[int]]:
    """Toxic and clean documents that hold a word or a stem, for those too toxic for chance, and the number of documents of either kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]
        for batch in batches:
            for text, label in zip(texts_of(batch["text"]), batch["label"].to_pylist(), strict=True):
                words = {w.strip(_STRIP) for w in text.decode("utf-8", "replace").lower().split()}
                stems = {w[:n] for w in words for n in _STEM_LENGTHS if len(w) > n}
                counts[label].update((w, False) for w in words if 3 <= len(w) <= 40)
                counts[label].update((w, True) for w in stems)
        keys = list(counts[0].keys() | counts[1].keys())
        columns = [[k[0] for k in keys], [k[1] for k in keys], [counts[1][k] for k in keys], [counts[0][k] for k in keys]]
        for i in range(0, len(keys), 50_000):
            part = [c[i : i + 50_000] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["term", "stem", "bad", "good"])

    totals = train.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    n_bad, n_good = totals[0], totals[1] - totals[0]
    if not n_bad or not n_good:
        return {}, [n_bad, n_good]
    counts = train.mapInArrow(run, "term string, stem boolean, bad bigint, good bigint").groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).cache()
    least = float(np.log(max(1, counts.count()) / 0.05))
    chosen = counts.where((F.col("bad") > 9 * F.col("good")) & (_surprise(n_bad, n_good) > least))
    rows = chosen.orderBy(F.desc("bad"), "term", "stem").limit(5000).collect()
    counts.unpersist()
    return _in_own_contexts(train, [(r.term, r.stem) for r in rows], n_bad, n_good, least), [n_bad, n_good]


def _surprise(n_bad: int, n_good: int) -> Column:
    """How unlikely the counts `bad` and `good` are by chance, as a logarithm; compared with that of the number of terms."""
    share, held = n_bad / (n_bad + n_good), F.col("bad") + F.col("good")
    good = F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (held * (1 - share)))).otherwise(0.0)
    return F.when(F.col("bad") > 0, F.col("bad") * F.log(F.col("bad") / (held * share)) + good).otherwise(0.0)


def _in_own_contexts(train: DataFrame, terms: list[tuple[str, bool]], n_bad: int, n_good: int, least: float) -> dict[tuple[str, bool], tuple[int, int]]:
    """The terms that stay surprising when each word before them, and each word after them, counts once: a copied passage counts once."""
    words, stems = {t: i for i, (t, stem) in enumerate(terms) if not stem}, {t: i for i, (t, stem) in enumerate(terms) if stem}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text, label in zip(texts_of(batch["text"]), batch["label"].to_pylist(), strict=True):
                tokens = ["", *(w.strip(_STRIP) for w in text.decode("utf-8", "replace").lower().split()), ""]
                for before, word, after in zip(tokens, tokens[1:], tokens[2:], strict=False):
                    found = [words.get(word), *(stems.get(word[:n]) for n in _STEM_LENGTHS if len(word) > n)]
                    rows.update((i, label, before, after) for i in found if i is not None)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], ["number", "label", "before", "after"])

    contexts = train.mapInArrow(run, "number int, label int, before string, after string").groupBy("number")

    def varied(label: int) -> Column:
        return F.least(*(F.count_distinct(F.when(F.col("label") == label, F.col(side))) for side in ("before", "after")))

    counts = contexts.agg(varied(1).alias("bad"), varied(0).alias("good"))
    rows = counts.where((F.col("bad") > 9 * F.col("good")) & (_surprise(n_bad, n_good) > least)).collect()
    return {terms[r.number]: (r.bad, r.good) for r in rows}


def choose_terms(counts: dict[tuple[str, bool], tuple[int, int]]) -> list[tuple[str, bool]]:
    """Words, and stems that stand for several words; nothing that a chosen stem already covers, misspellings included: a stem
    too short for an edit leaves words of five letters or more in."""
    words = {w: bad for (w, stem), (bad, _) in counts.items() if not stem}
    stems = []
    for (stem, is_stem), (bad, good) in sorted(counts.items(), key=lambda x: (len(x[0][0]), x[0][0])):
        if is_stem and not any(stem.startswith(s) for s in stems) and good * 20 <= bad:
            commonest = max((n for w, n in words.items() if w.startswith(stem)), default=0)
            if bad >= 1.5 * commonest and bad >= 4:
                stems.append(stem)
    return [(s, True) for s in stems] + [(w, False) for w in sorted(words) if not any(w.startswith(s) and (len(s) >= 5 or len(w) < 5) for s in stems)]


def _features(hits: list[tuple[str, int, int, bool]]) -> list[float]:
    """A constant, and the logarithms of weighted hits: abusive (a misspelling counts half) and quoted."""
    plain = sum(1.0 if edits == 0 else 0.5 for _, _, edits, quote in hits if not quote)
    quotes = sum(1.0 if edits == 0 else 0.5 for _, _, edits, quote in hits if quote)
    return [1.0, float(np.log1p(plain)), float(np.log1p(quotes))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; slopes are kept from below zero."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        w[1:] = np.maximum(w[1:], 0)
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from at most `max_rows` labelled rows outside the held-out fifth.

    Words near a term that clean documents hold as well are innocent: they only match as themselves. Without toxic rows the
    lexicon is empty and every text gets the share of toxic rows.
    """
    rows = training_rows(labels, "toxic", max_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("of")).select("text", "label").cache()
    counts, totals = _term_counts(train)
    lexicon = Lexicon(choose_terms(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for batch in batches:
            hits = [finder.hits(t) for t in texts_of(batch["text"])]
            kind = pa.list_(pa.struct([("word", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))
            rows = [[{"word": w, "edits": e, "quoted": q} for w, _, e, q in found] for found in hits]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(rows, kind)], ["label", "hits"])

    seen = train.mapInArrow(run, "label int, hits array<struct<word:string,edits:int,quoted:boolean>>").collect()
    train.unpersist()
    near: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for row in seen:
        for word in {h.word for h in row.hits if h.edits}:
            near[word][row.label] += 1
    innocent = frozenset(w for w, (good, bad) in near.items() if good and (bad + 0.5) / (totals[0] + 1) < 5 * (good + 0.5) / (totals[1] + 1))
    lexicon = Lexicon(lexicon.terms, innocent)
    x = np.array([_features([(h.word, 0, h.edits, h.quoted) for h in row.hits if not (h.edits and h.word in innocent)]) for row in seen]).reshape(-1, 3)
    return Model(lexicon, fit_logistic(x, np.array([row.label for row in seen], dtype=float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` (0 to 1) and `n_hits` from its whole texts; columns of these names are replaced. A missing text is empty."""
    names = [c for c in docs.columns if c not in ("score", "n_hits")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand terms at most
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        finder = Finder(model.lexicon)
        for batch in batches:
            hits = [finder.hits(t) for t in texts_of(batch["text"])]
            x = np.array([_features(found) for found in hits]).reshape(-1, 3)
            value = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(value), pa.array([len(h) for h in hits], pa.int64())], [*names, "score", "n_hits"])

    return docs.select(*names).mapInArrow(run, f"{fields}, score double, n_hits bigint")
