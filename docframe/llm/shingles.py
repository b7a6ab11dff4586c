"""Words of texts and hashes of runs of words, for many texts at once, with numpy.

A word is hashed by mixing its blocks of 8 bytes in turn, and runs of words by doubling, each step
mixing two halves.  No step is linear, so no wording of a text makes hashes collide by structure.
Hashes only propose: operators that merge or remove anything compare the words themselves afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_KEY = b"words of docframe"
#: Bytes of a word from which on it is hashed by BLAKE2b instead.
LONG = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The first n bytes of a block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_ODD) + _U(seed * 0x51ED27 + 1))


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, key=_KEY).digest(), "little")


def _stirred(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    h = (h ^ block) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(32))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(29))


def _word_hashes(data: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end]; 8 bytes must follow the last of them."""
    blocks = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    sizes = ends - begins
    h = _stirred(mix(sizes.astype(_U) * _U(_ODD)), blocks[begins] & _FIRST[np.minimum(sizes, 8)])
    at, more = 8, np.flatnonzero((sizes > 8) & (sizes < LONG))
    while len(more):
        h[more] = _stirred(h[more], blocks[begins[more] + at] & _FIRST[np.minimum(sizes[more] - at, 8)])
        at += 8
        more = more[sizes[more] > at]
    for k in np.flatnonzero(sizes >= LONG).tolist():
        h[k] = _digest(data[begins[k] : ends[k]])
    return h


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _U(_ODD) + (b ^ (b >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class Words:
    """The words of a batch of texts: their hashes, and where each text's words begin and end."""

    def __init__(self, texts: list[bytes]):
        self._data = b"\n".join([*texts, bytes(8)])
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        inside = ~_SPACE[np.frombuffer(self._data, np.uint8)[: int(lens.sum())]]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self._first, self._last = edges[0::2], edges[1::2]
        self.hashes = _word_hashes(self._data, self._first, self._last)
        self.ends = np.searchsorted(self._first, np.cumsum(lens))
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if texts else self.ends

    def words(self, begin: int, end: int) -> bytes:
        """These words, of one text, joined by one space."""
        return b" ".join(self._data[self._first[begin] : self._last[end - 1]].split()) if end > begin else b""

    def starts(self, k: int) -> np.ndarray:
        """First words of all runs of k words that lie in one text."""
        left = np.repeat(self.ends, self.ends - self.begins) - np.arange(len(self.hashes))
        return np.flatnonzero(left >= k)

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, as far as the batch reaches (runs may cross texts)."""
        h, size = self.hashes, 1
        if len(h) < k:
            return h[:0]
        while 2 * size <= k:
            h, size = _joined(h[:-size], h[size:]), 2 * size
        return _joined(h[: len(h) - (k - size)], h[k - size :]) if size < k else h

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word shingles of all texts, text by text, and how many each has.

        A text of fewer words has one shingle of all of them; one without words has none.
        """
        counts = self.ends - self.begins
        per = np.where((counts > 0) & (counts < k), 1, np.maximum(counts - k + 1, 0))
        first = np.repeat(self.begins - (np.cumsum(per) - per), per) + np.arange(per.sum())
        runs = self.runs(k)
        out = runs[np.minimum(first, len(runs) - 1)] if len(runs) else np.zeros(len(first), _U)
        at = np.cumsum(per) - per
        for t in np.flatnonzero((counts > 0) & (counts < k)).tolist():
            out[at[t]] = _digest(self.words(int(self.begins[t]), int(self.ends[t])))
        return out, per
