import os

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leadwave.llm import token_counts
from leadwave.llm.token_counts import count_tokens, frequent_pre_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \t\n ", "Hello  hello\thello world", "don't they'Ll 'S it's", "a<|endoftext|>b <|startoftext|><|endoftext|> <|endoftext|", "İΣΑΣ ΣΑΣ ᾳ Ǆ",
    "é ́ e ́x", "x\x1cy\u0085z w　v u", "日本語 テキスト 123 4५6", "!!!! $$$ %%% …—", "👍🏽 ​﻿z", "a" * 3000, "hello " * 20_000, "\x00 \x01a",
]


@pytest.mark.parametrize("size", [0, 3, 1000])
def test_as_the_library_counts(table, size):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "hello"), (None, "new words")]
    got = count_tokens(table(rows, n_tokens="x", words="y"), PATH, size).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for _, t in rows)
    assert sorted((r.text or "", r.n_tokens) for r in got) == want


def test_frequent_pre_tokens_and_small_caches(table, monkeypatch):
    rows = [(i, "the the the of of and " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)]
    assert frequent_pre_tokens(table(rows), 3) == [b"the", b"of", b"and"]
    monkeypatch.setattr(token_counts, "_CACHE", 10)
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.n_tokens for r in count_tokens(table(rows), PATH, 2).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_empty_table(table):
    assert count_tokens(table([]), PATH).collect() == []


def test_tasks_keep_the_library_from_threads_of_its_own(table, monkeypatch):
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    docs, tasks = table([(1, "hello"), (2, "new words")]), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append(run) or plain(self, run, schema))
    count_tokens(docs, PATH, 0)
    (counted,) = tasks[-1](iter([pa.RecordBatch.from_pydict({c: ["1", "2"] if c != "text" else ["hello", "new words"] for c in docs.columns})]))
    assert counted["n_tokens"].to_pylist() == [1, 2]
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
