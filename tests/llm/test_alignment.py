import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from leadwave.llm import alignment
from leadwave.llm.alignment import align

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
RANDOM = random.Random(4)
ODD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "a   b  ", "  a\n b\n  c \n", "tab\t\t x \t y", "x  y z　 w   v​ u﻿ t",
    "it's they'll 'S don't've", "a<|endoftext|>b <|endoftext|> <s> </s> <unk>", "lower▁under ▁", "café café üß İ ﬁ",
    "日本語 テキスト 123 4५6", "\U0001f44d\U0001f3fd …— !!!! $$$", "\x00 \x01a \x1c \x85 q", "a" * 3000, "x " * 5000, "1234567890 3.14159e-10 0xdeadBEEF",
    "<0x41> A <0x0A>\n", "жизнь жизнь  и", "\r\n\r\n a\r\nb", "word.\nNext line.\n\n  indented", "᠎     x",
]


def by_hand(rows):
    """The contract from whole texts: sorted (id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest), and each pair's (docs, links)."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PATHS[1])
    of = alignment.byte_level_bytes()
    plain = []
    for key, text in rows:
        plain.append((key, [], [], [], 0))
        if not text:
            continue
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            continue
        ends = []
        for tokens in (bytes_a, bytes_b):
            at, out = 0, []
            for t in tokens:
                out.append((at, at := at + len(t)))
            ends.append(out)
        links = [(x, y) for x, (s, e) in zip(ids_a, ends[0], strict=True) for y, (t, f) in zip(ids_b, ends[1], strict=True) if s < f and t < e] if len(ids_a) < 800 else swept(ids_a, ids_b, ends)
        both = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups = [(",".join(str(i) for i, (_, e) in zip(ids_a, ends[0], strict=True) if lo < e <= hi), ",".join(str(i) for i, (_, e) in zip(ids_b, ends[1], strict=True) if lo < e <= hi)) for lo, hi in zip([0, *both], both)] if len(ids_a) < 800 else None
        plain[-1] = (key, ids_a, ids_b, links, groups if groups is not None else len(both))
    totals = Counter(link for r in plain for link in r[3])
    in_docs = Counter(link for r in plain for link in set(r[3]))
    most = {}
    for (_, y), n in totals.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for key, ids_a, ids_b, links, groups in plain:
        digest = hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if isinstance(groups, list) and groups else "" if not ids_a else None
        n_groups = len(groups) if isinstance(groups, list) else groups
        out.append((key, len(ids_a), len(ids_b), n_groups, len(links), sum(totals[x] == most[x[1]] for x in links), sum(totals[x] for x in links), digest))
    return out, {k: (in_docs[k], totals[k], totals[k] == most[k[1]]) for k in totals}


def swept(ids_a, ids_b, ends):
    x = y = 0
    out = []
    while x < len(ids_a):
        out.append((ids_a[x], ids_b[y]))
        end_a, end_b = ends[0][x][1], ends[1][y][1]
        x, y = x + (end_a <= end_b), y + (end_b <= end_a)
    return out


def keyed(table, rows, **extra):
    return table(rows, **extra).withColumnRenamed("doc_id", "doc_key")


def same(found, rows):
    names = ("doc_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = sorted((tuple(r[n] for n in names) for r in found.documents.collect()), key=repr)
    want, pairs = by_hand(rows)
    long = {r[0] for r in want if r[-1] is None}
    strip = sorted(((*r[:-1], None) if r[0] in long else r for r in got), key=repr)
    assert strip == sorted(want, key=repr)
    assert {(r.a, r.b): (r.n_docs, r.n_links, r.is_best) for r in found.pairs.collect()} == pairs


def prose(n):
    words = ["the", "The", "tokenizer", "unbelievable", "résumé", "12,5", "naïve", "город", "化学", "x1y2", "(see", "below)", "\n", "", "end."]
    return [(i, " ".join(RANDOM.choices(words, k=RANDOM.randrange(1, 120)))) for i in range(n)]


def test_odd_texts(table):
    rows = list(enumerate(ODD)) + [(3, "a"), (None, "a b"), (None, "a b")]
    same(align(keyed(table, rows, segment="x", place="y", a="z"), *PATHS), rows)


def test_prose_in_many_small_segments(table, monkeypatch):
    rows = prose(120) + [(1000 + i, t) for i, (_, t) in enumerate(prose(3))] + [(500 + i, "same words of the copies") for i in range(50)]
    same(align(keyed(table, rows).repartition(3), *PATHS), rows)
    monkeypatch.setattr(alignment, "SEGMENT_POSTINGS", 50)
    monkeypatch.setattr(alignment, "SEGMENT_DOCS", 16)
    monkeypatch.setattr(alignment, "_CACHE", 10)
    monkeypatch.setattr(alignment, "pieces", lambda texts: ((i, i + 1) for i in range(len(texts))))
    same(align(keyed(table, rows).repartition(3), *PATHS), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, "▁")]])
def test_without_tokens(table, rows):
    same(align(keyed(table, rows), *PATHS), rows)


def test_a_vocabulary_across_spaces_is_refused():
    with pytest.raises(Exception, match="Internal|Not found|parse|reach across"):
        alignment.Aligner(PATHS[0], PATHS[0])
