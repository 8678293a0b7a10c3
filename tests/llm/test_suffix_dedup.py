import hashlib
import random

from brute import repeats
from leadwave.llm.suffix_dedup import remove_repeats, repeat_digests

RANDOM = random.Random(3)
BASE = "".join(RANDOM.choice("abcd é") for _ in range(4000))
ROWS = list(
    enumerate(
        [
            "a" * 1000, "a" * 399, "a" * 400, "ab" * 300, "abc" * 200 + "q", "q" + "abc" * 140,  # periodic
            BASE, BASE[100:600], BASE[300:699] + "é" + BASE[699:], None, "", "short",
            *(BASE[RANDOM.randrange(3000) :][: RANDOM.randrange(300, 1200)] + RANDOM.choice("xyz") * RANDOM.randrange(500) for _ in range(30)),
        ]
    )
)


def digests(df, *args):
    return sorted(map(tuple, repeat_digests(df, *args).collect()))


def test_every_byte_of_a_repeated_string_goes(table):
    assert digests(table(ROWS)) == repeats(ROWS, 400)


def test_shorter_strings_and_small_phrases(table):
    assert digests(table(ROWS), 40, 16, 8) == repeats(ROWS, 40)


def test_kept_bytes(table):
    kept = remove_repeats(table(ROWS, row="x", text_2="y", kept="z")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in kept) == repeats(ROWS, 400)


def test_rows_equal_in_id_and_text_repeat_each_other(table):
    rows = [(7, BASE[:700]), (7, BASE[:700]), (None, BASE[2000:2500]), (None, BASE[2000:2500]), (None, "x")]
    got = [tuple(r) for r in repeat_digests(table(rows)).collect()]
    key = lambda r: (r[0] is None, r[1])
    assert sorted(got, key=key) == sorted(repeats(rows, 400), key=key)


def test_one_string_in_many_texts(table):
    passage = BASE[:450]
    rows = [(i, f"{i:04d}" * 40 + passage + f"{i * 7:05d}" * 40) for i in range(200)]
    assert digests(table(rows)) == repeats(rows, 400)


def test_a_text_of_many_segments(table):
    long = "".join(RANDOM.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(0, long), (1, long[1_048_000:1_049_500]), (2, long[5:405])]
    got = {r.doc_id: r for r in repeat_digests(table(rows)).collect()}
    assert got[0].n_removed == 1500 + 400 and got[0].n_spans == 2
    assert got[1].n_removed == 1500 and got[2].n_removed == 400


def test_empty_table(table):
    assert digests(table([])) == []
