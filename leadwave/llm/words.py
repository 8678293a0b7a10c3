"""Words, word hashes and k-gram hashes of whole texts as NumPy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
_SEGMENT = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


BYTE_VALUES = seeded(256, 11)
_BASE, _MODULUS = 0x5851F42D4C957F2D, 1 << 64
STEPS = seeded(64, 23) | U(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(_SEGMENT + 1, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, _MODULUS))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_byte = np.arange(256)
#: Characters of a word: all but ASCII white space; or ASCII letters and digits and everything beyond ASCII.
NOT_SPACE = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))
ALPHANUMERIC = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _BASE, dtype=U), np.full(size, pow(_BASE, -1, _MODULUS), dtype=U)
        up[0] = down[0] = 1
        _UP, _DOWN = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _UP, _DOWN


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix, so that any substring's hash is a difference (see span_hash)."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(BYTE_VALUES[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in [start, end), the same wherever they lie."""
    return mix64((prefixes[ends] - prefixes[starts]) * powers(len(prefixes))[1][starts] + (ends - starts).astype(U))


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of every word."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = is_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of many spans with rising starts, segment by segment so that long texts need no long arrays of powers."""
    out, i = np.empty(len(starts), dtype=U), 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + _SEGMENT, side="left"))
        first = starts[i]
        out[i:j] = span_hash(prefix_hash(data[first : ends[i:j].max()]), starts[i:j] - first, ends[i:j] - first)
        i = j
    return out


class Words:
    """The words of several texts in one array; text t has the words first[t] to first[t + 1]."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: bool = True):
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        self.data = LOWER[data] if lower else data
        self.starts, self.ends = word_spans(self.data, is_word)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.first = np.concatenate(([0], np.searchsorted(self.starts, np.cumsum(sizes) - 1))).astype(np.int64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and whether the run starting at each word stays within its text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, dtype=U), np.empty(0, dtype=bool)
        total = self.hashes[:n] * STEPS[0]
        for j in range(1, k):
            total = total + self.hashes[j : j + n] * STEPS[j]
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return mix64(total + U(k)), text[:n] == text[k - 1 : k - 1 + n]


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each of `bits` groups of hashes whether a set has an odd number of them, as 64-bit integers. Two sets differ in at least as
    many hashes as these differ in bits; integers combined by XOR are those of fewer, larger groups."""
    odd = np.bincount((hashes >> U(20) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def text_hash(hashes: np.ndarray) -> np.ndarray:
    """Hash of a whole sequence of word hashes (used for sequences shorter than k)."""
    with np.errstate(over="ignore"):
        return mix64((hashes * STEPS[: len(hashes)]).sum(dtype=U, keepdims=True) + U(len(hashes)))
