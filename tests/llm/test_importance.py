import hashlib
import math
import random
import zlib

from brute import ALPHANUMERIC, LOWER

from leadwave.llm.importance import importance_ranks, resample

RANDOM = random.Random(5)


def by_hand(rows, items, percent, longest=1, buckets=10_000, min_words=20, seed=2024):
    """Rows of (id, n_words, n_features, weight, score, rank)."""

    def features(text):
        words = ALPHANUMERIC.findall((text or "").translate(LOWER))
        return len(words), [" ".join(words[p : p + k]) for k in range(1, longest + 1) for p in range(len(words) - k + 1)]

    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    docs, wanted = [(i, *features(t)) for i, t in rows], [f for t in items for f in features(t)[1]]
    s, t = [0] * buckets, [0] * buckets
    for feature in (f for _, _, found in docs for f in found):
        s[bucket(feature)] += 1
    for feature in wanted:
        t[bucket(feature)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, n, found in docs:
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = len(able) * percent // 100
    return out, [r[0] for r in able[:drawn]]


def texts(n):
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "ñ", "ß", "日本"]
    return [(i, " ".join(RANDOM.choices(vocabulary, k=RANDOM.choice([0, 5, 19, 20, 21, 60, 300])))) for i in range(n)]


def check(table, rows, items, percent, **how):
    target = table([(i, t) for i, t in enumerate(items)], bucket="x").drop("doc_id")
    got = importance_ranks(table(rows, rank="x", score="y", bucket="z"), target, percent, **how).collect()
    want, drawn = by_hand(rows, items, percent, **how)
    plain = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got]
    assert sorted(plain, key=repr) == sorted(want, key=repr)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_as_by_hand(table):
    rows = texts(150) + [(200, None), (201, ""), (202, "-- \x00 !"), (203, "Don't\tSTOP İ Ǆ ǆ"), (204, "one " * 30_000)]
    check(table, rows, ["w1 w2 w3 w250", "w1 W1 É", None, ""], 10)


def test_longer_features_and_other_parameters(table):
    check(table, texts(60), ["w1 w2 w3 w4", "w5"], 37, longest=3, buckets=97, min_words=5, seed=7)


def test_ties_missing_and_repeated_ids(table):
    same = "same words " * 15
    rows = [(4, same), (4, same), (None, same), (2, same), (None, "other words " * 12)] + texts(20)
    check(table, rows, ["other"], 100)


def test_empty_tables(table):
    check(table, [], ["a"], 10)
    check(table, texts(30), [], 10)
    check(table, [(1, None), (2, "few words")], ["a"], 100)


def test_resample_returns_whole_rows(table):
    rows = texts(80)
    docs = table(rows, kept="k")
    _, drawn = by_hand(rows, ["w1 w2"], 25)
    got = resample(docs, table([(0, "w1 w2")]), 25)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(drawn)
