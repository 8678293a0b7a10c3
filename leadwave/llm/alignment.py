"""Cross-tokenizer alignment: co-occurrence of two vocabularies' tokens over the same bytes, by inverted pair bitmaps."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from leadwave.llm.common import pieces, scratch, stash, texts_of
from leadwave.session import broadcast_if_small

# A segment of documents ends at about this many postings, or at 65,536 documents, so a place in it takes two bytes.
SEGMENT_POSTINGS = 1_000_000
SEGMENT_DOCS = 1 << 16
_CACHE = 200_000
_SEGMENT_BITS = 20

# Both tokenizers part at a space that follows a character surely not white space (nor one that some library counts as such).
_CUT = re.compile(r" (?<![\s\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff] )")

_ROWS = (
    "kind int, segment bigint, place int, doc_key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "a int, b int, weight bigint, counts_documents boolean, sparse binary, dense binary"
)
_NAMES = [field.split()[0] for field in _ROWS.split(", ")]


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the
    others for the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Aligner:
    """Tokens, links and groups of texts cut into units, remembered for units met before.

    A unit is a space (or several) and the characters up to the next space that follows a character other than white space. Neither
    tokenizer has a token across the start of a unit: the byte-level pre-tokeniser starts a pre-token there, and no piece of the other
    vocabulary has a space after another character, which is checked. So both end a token there, and a text's tokens, links
    and groups are its units' one after the other.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        of = byte_level_bytes()
        added = {i for i in self.a.get_added_tokens_decoder()}
        vocabulary = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.bytes_a = {i: t.encode() if i in added else bytes(of[c] for c in t) for t, i in vocabulary}
        listed = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in listed):
            raise ValueError("the second vocabulary has tokens that reach across a space")
        self.bytes_b = [_piece_bytes(p) for p in listed]
        self.width_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.width_a[list(self.bytes_a)] = [len(t) for t in self.bytes_a.values()]
        self.width_b = np.array([len(t) for t in self.bytes_b])
        # Each id as text with the separator inside its group's side, and with the one at that side's end.
        self.written = [f"{i}{c}" for n, end in ((len(self.width_a), "|"), (len(self.width_b), ";")) for i in range(n) for c in (",", end)]
        self.space = self.b.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups = (np.zeros(0, np.int64) for _ in range(3))
        self.same = np.zeros(0, bool)
        self.groups: list[str] = []
        self.links, self.link_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def cut(self, text: str) -> list[str]:
        """The units of a text, without their first space."""
        return _CUT.split(" " + text)[1:]

    def numbers(self, units: list[str]) -> np.ndarray:
        """Where the units' results stand; new ones are tokenised."""
        out = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        if (out < 0).any():
            new = list(dict.fromkeys(units[i] for i in np.flatnonzero(out < 0).tolist()))
            self._learn(new)
            out = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        return out

    def _learn(self, units: list[str]) -> None:
        """Tokenise units and align all their tokens at once, side by side as bytes of one text."""
        of_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        # The library gives none for an empty text, but one for a space at a text's end.
        of_b = [ids if unit else [self.space] for unit, ids in zip(units, self.b.encode(units, num_threads=1), strict=True)]
        self.index.update(zip(units, range(len(self.index), len(self.index) + len(units)), strict=True))
        same = self._same_bytes([(" " + u).encode() for u in units], of_a, of_b)
        if not same.all():
            of_a, of_b = ([ids if good else [] for ids, good in zip(x, same.tolist(), strict=True)] for x in (of_a, of_b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((of_a, n_a), (of_b, n_b)))
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        size = int(ends_a[-1]) if len(ends_a) else 0
        is_end = np.zeros((2, size + 1), bool)
        is_end[0, ends_a] = is_end[1, ends_b] = True
        # Every byte where a token of either side ends closes one link: of the tokens of both sides that hold the byte before.
        at = np.flatnonzero(is_end[0] | is_end[1])
        tokens_before = np.cumsum(is_end, axis=1)
        links = a[tokens_before[0, at - 1]] << 32 | b[tokens_before[1, at - 1]]
        cuts = np.flatnonzero(is_end[0] & is_end[1])
        unit_ends = np.concatenate(([0], ends_a))[np.cumsum(n_a)]
        n_links = np.diff(np.searchsorted(at, unit_ends, side="right"), prepend=0)
        n_groups = np.diff(np.searchsorted(cuts, unit_ends, side="right"), prepend=0)

        self.groups += self._written(a, b, tokens_before[:, cuts], n_a + n_b)
        self.n_a, self.n_b, self.n_groups = (np.append(x, y) for x, y in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)))
        self.same = np.append(self.same, same)
        self.links = np.append(self.links, links)
        self.link_ends = np.append(self.link_ends, self.link_ends[-1] + np.cumsum(n_links))

    def _same_bytes(self, whole: list[bytes], of_a: list[list[int]], of_b: list[list[int]]) -> np.ndarray:
        """Whether the tokens of both sides join to the bytes of each unit."""
        same = np.ones(len(whole), bool)
        for ids, table in ((of_a, self.bytes_a), (of_b, self.bytes_b)):
            joined = [b"".join(map(table.__getitem__, i)) for i in ids]
            if joined != whole:
                same &= np.fromiter((x == y for x, y in zip(joined, whole, strict=True)), bool, len(whole))
        return same

    def _written(self, a: np.ndarray, b: np.ndarray, cuts: np.ndarray, n_tokens: np.ndarray) -> list[str]:
        """The groups of each unit as text, a separator after every id; `cuts` has the number of tokens of either side at each group's end."""
        before = np.concatenate((np.zeros((2, 1), np.int64), cuts), axis=1)
        sizes = np.diff(before)
        place_a = np.arange(len(a)) + np.repeat(before[1, :-1], sizes[0])
        place_b = np.arange(len(b)) + np.repeat(before[0, 1:], sizes[1])
        last = np.zeros((2, max(len(a), len(b), 1)), bool)
        last[0, cuts[0] - 1] = last[1, cuts[1] - 1] = True
        code = np.empty(len(a) + len(b), np.int64)
        code[place_a] = 2 * a + last[0, : len(a)]
        code[place_b] = 2 * (b + len(self.width_a)) + last[1, : len(b)]
        texts = list(map(self.written.__getitem__, code.tolist()))
        ends = np.cumsum(n_tokens).tolist()
        return ["".join(texts[first:end]) for first, end in zip([0, *ends], ends, strict=False)]

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links of the units in order, as A id and B id in one number, and how many each unit has."""
        first, n = self.link_ends[units], self.link_ends[units + 1] - self.link_ends[units]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.links[at], n


@functools.cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, which keeps it from task to task."""
    return Aligner(path_a, path_b)


def _batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    types = dict(field.split() for field in _ROWS.split(", "))
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(rows, arrow[types[n]])).cast(arrow[types[n]]) for n in _NAMES], _NAMES)


def _bitmap_rows(segment: int, n_docs: int, pair: np.ndarray, place: np.ndarray, weight: int, counts_documents: bool) -> Iterator[pa.RecordBatch]:
    """One compressed bitmap for each pair of (pair, place) sorted by both: places of two bytes, or bits if those are shorter."""
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    sizes = np.diff(starts, append=len(pair))
    width = -(-n_docs // 8)
    is_dense = 2 * sizes > width
    for dense in (False, True):
        chosen = np.flatnonzero(is_dense == dense)
        if not len(chosen):
            continue
        if dense:
            bits = np.zeros((len(chosen), width * 8), bool)
            for row, group in enumerate(chosen.tolist()):
                bits[row, place[starts[group] : starts[group] + sizes[group]]] = True
            data, ends = np.packbits(bits, axis=1).tobytes(), np.arange(len(chosen) + 1, dtype=np.int32) * width
        else:
            data = place[np.repeat(~is_dense, sizes)].astype(np.uint16).tobytes()
            ends = np.concatenate(([0], np.cumsum(2 * sizes[chosen]))).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        ids, rows = pair[starts[chosen]], len(chosen)
        yield _batch(
            rows, kind=pa.array(np.ones(rows, np.int32)), segment=pa.array(np.full(rows, segment)), a=pa.array((ids >> 32).astype(np.int32)),
            b=pa.array((ids & 0xFFFFFFFF).astype(np.int32)), weight=pa.array(np.full(rows, weight)), counts_documents=pa.array(np.full(rows, counts_documents)),
            **{"dense" if dense else "sparse": held})


def _segment_bitmaps(segment: int, n_docs: int, postings: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of a segment's postings (pair, place, multiplicity): the documents of each pair, and its planes.

    Plane k has the documents in which bit k of (multiplicity - 1) is set, so a pair's links are its documents and 2^k times
    each plane's.
    """
    if not postings:
        return
    pair, place, times = np.concatenate(postings, axis=1)
    order = np.lexsort((place, pair))
    pair, place, times = pair[order], place[order], times[order] - 1
    yield from _bitmap_rows(segment, n_docs, pair, place, 1, True)
    bit = 0
    while (times >> bit).any():
        held = (times >> bit) & 1 == 1
        yield from _bitmap_rows(segment, n_docs, pair[held], place[held], 1 << bit, False)
        bit += 1


def inverted_bitmaps(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Tokenise every row of (doc_key, text) once; the rows of its documents and of its pair bitmaps, in the shared folder.

    Documents of a task are numbered by segment and place in it. Bitmaps of one segment lie in one task, and no two segments have a
    document in common, so the OR of a pair's bitmaps is all of them side by side, and their popcounts add up.
    """
    context = docs.sparkSession.sparkContext
    for path in (path_a, path_b):
        context.addFile(path)
    files = [path.rsplit("/", 1)[-1] for path in (path_a, path_b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*map(SparkFiles.get, files))
        segment, n_docs, n_postings, postings = TaskContext.get().partitionId() << _SEGMENT_BITS, 0, 0, []
        for batch in batches:
            texts = batch["text"].to_pylist()
            for i, j in pieces(texts_of(batch["text"])):
                for first in range(i, j, SEGMENT_DOCS):
                    last = min(j, first + SEGMENT_DOCS)
                    if n_docs and (n_postings >= SEGMENT_POSTINGS or n_docs + last - first > SEGMENT_DOCS):
                        yield from _segment_bitmaps(segment, n_docs, postings)
                        segment, n_docs, n_postings, postings = segment + 1, 0, 0, []
                    if len(aligner.index) > _CACHE:
                        aligner.clear()
                    rows, held = _aligned(aligner, texts[first:last])
                    held[1] += n_docs
                    yield _batch(
                        last - first, kind=pa.array(np.zeros(last - first, np.int32)), segment=pa.array(np.full(last - first, segment)),
                        place=pa.array(np.arange(n_docs, n_docs + last - first)), doc_key=batch["doc_key"].slice(first, last - first), **rows)
                    n_docs, n_postings = n_docs + last - first, n_postings + held.shape[1]
                    postings.append(held)
        yield from _segment_bitmaps(segment, n_docs, postings)

    found = stash(docs.select("doc_key", "text").mapInArrow(run, _ROWS), "bitmaps")
    documents = found.where("kind = 0").select("segment", "place", "doc_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return documents, found.where("kind = 1").select("segment", "a", "b", "weight", "counts_documents", "sparse", "dense")


def _aligned(aligner: Aligner, texts: list[str | None]) -> tuple[dict[str, pa.Array], np.ndarray]:
    """Figures of each text, and postings (pair, text, multiplicity)."""
    cut = [aligner.cut(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    units = aligner.numbers([u for c in cut for u in c])
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(texts)), counts)
    good = np.bincount(text, weights=~aligner.same[units], minlength=len(texts)) == 0
    used = good[text]
    totals = {}
    for name in ("n_a", "n_b", "n_groups"):
        totals[name] = np.bincount(text[used], weights=getattr(aligner, name)[units[used]], minlength=len(texts)).astype(np.int64)
    digests = []
    for t, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        held = "".join(map(aligner.groups.__getitem__, units[end - n : end].tolist())) if good[t] else ""
        digests.append(hashlib.sha256(held[:-1].encode()).hexdigest() if held else "")
    pairs, n = aligner.links_of(units[used])
    of = np.repeat(text[used], n)
    totals["n_links"] = np.bincount(of, minlength=len(texts))
    distinct, number = np.unique(pairs, return_inverse=True)
    held, times = np.unique(number * len(texts) + of, return_counts=True)
    postings = np.stack((distinct[held // len(texts)], held % len(texts), times)) if len(held) else np.zeros((3, 0), np.int64)
    return {k: pa.array(v) for k, v in totals.items()} | {"groups_sha256": pa.array(digests, pa.string())}, postings


def pair_counts(bitmaps: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, is_best) of every pair of ids linked anywhere: popcounts of its bitmaps and planes, added up before
    they are shuffled. is_best: no other pair of the same b has more links."""
    ones = F.coalesce(F.bitmap_count("dense"), F.lit(0)) + F.coalesce(F.octet_length("sparse") / 2, F.lit(0)).cast("bigint")
    docs = F.sum(F.when(F.col("counts_documents"), ones).otherwise(0))
    totals = bitmaps.groupBy("a", "b").agg(docs.alias("n_docs"), F.sum(ones * F.col("weight")).alias("n_links"))
    totals = stash(totals, "pairs")
    most = totals.groupBy("b").agg(F.max("n_links").alias("most"))
    return totals.join(broadcast_if_small(most), "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("is_best"))


def _document_sums(bitmaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(segment, place, n_best, count_sum): the pairs' scores brought back to the documents in their postings."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        weight, best = table["weight"].to_numpy(), table["is_best"].to_numpy()
        scores = np.stack((weight * best, weight * table["n_links"].to_numpy()))
        sums = np.zeros((2, SEGMENT_DOCS), np.int64)
        is_dense = table["dense"].is_valid().to_numpy()
        sparse = table["sparse"].drop_null().to_pylist()
        places = np.frombuffer(b"".join(sparse), np.uint16)
        sizes = np.fromiter(map(len, sparse), np.int64, len(sparse)) // 2
        for row in range(2):
            np.add.at(sums[row], places, np.repeat(scores[row, ~is_dense], sizes))
        for held, values in zip(table["dense"].drop_null().to_pylist(), scores[:, is_dense].T, strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8)))
            sums[:, at] += values[:, None]
        used = np.flatnonzero(sums[1])
        columns = [np.full(len(used), key[0].as_py()), used.astype(np.int32), sums[0, used], sums[1, used]]
        return pa.table(dict(zip(("segment", "place", "n_best", "count_sum"), columns, strict=True)))

    scored = bitmaps.drop("counts_documents").join(broadcast_if_small(pairs.select("a", "b", "n_links", "is_best")), ["a", "b"])
    return scored.select("segment", "weight", "n_links", "is_best", "sparse", "dense").groupBy("segment").applyInArrow(run, "segment bigint, place int, n_best bigint, count_sum bigint")


@dataclass
class Alignment:
    """`documents`: (doc_key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256); `pairs`: see pair_counts."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str) -> Alignment:
    """Align the tokens of a byte-level BPE (`path_a`, a tokenizers file) and of a piece BPE that adds a leading space
    (`path_b`, a sentencepiece model) over every whole text of (doc_key, text).

    The first reads a space and the text, so both see the same bytes. Special strings inside texts are plain text. A row whose text
    is missing or empty, or whose tokens of either side do not join to those bytes, has no tokens: zeros and an empty digest.
    Rows are known by their place, so missing or repeated keys need no special case.
    """
    with scratch(docs.sparkSession):
        documents, bitmaps = inverted_bitmaps(docs, path_a, path_b)
        pairs = stash(pair_counts(bitmaps), "scored", keep=True)
        sums = _document_sums(bitmaps, pairs)
        joined = documents.join(sums, ["segment", "place"], "left")
        zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
        return Alignment(stash(joined.select("doc_key", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256"), "aligned", keep=True), pairs)
