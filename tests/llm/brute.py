"""Plain definitions of what the operators compute."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def repeats(rows, length):
    """Rows of (id, n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, text in texts:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if seen[text[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(text)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows, items, window=13):
    """(id, n_words, n_hit, n_items, sha256 of the item list, contaminated)"""
    windows = defaultdict(set)
    for item, text in items:
        words = ALPHANUMERIC.findall((text or "").translate(LOWER))
        n = min(window, len(words))
        for p in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[p : p + n])].add(str(item))
    out = []
    for i, text in rows:
        words, hit, found = ALPHANUMERIC.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                if (key := tuple(words[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[key]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def shingles(text, k=5):
    words = NOT_SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[p : p + k]) for p in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def components(rows, up=4, down=5, k=5):
    """{id: (n_shingles, component)} by comparing every pair."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and down * both >= up * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def weighted_jaccard(a, b):
    x, y = Counter(NOT_SPACE.findall(a)), Counter(NOT_SPACE.findall(b))
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
