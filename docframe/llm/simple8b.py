"""Simple-8b: unsigned integers packed into 64-bit words, coded and decoded with numpy.

The top four bits of a word are its selector; selector s packs COUNTS[s] values of WIDTHS[s] bits,
the first in the lowest bits.  Selector 0 is an escape: its value, of over 60 bits, is the next of
the raw words that follow the packed ones.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: values per word and bits per value, by selector (0 is the escape).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

_U = np.uint64


def _selectors(v: np.ndarray) -> np.ndarray:
    """The narrowest selector that fits at each value: none of the next COUNTS values is too wide."""
    n, most = len(v), int(v.max())
    small = v.astype(np.uint32) if most < 1 << 32 else v
    chosen = np.full(n, 14, np.uint8)
    if most >> 60:
        chosen[v >> _U(60) > 0] = 0
    # from wide to narrow: a narrower one needs a longer run still
    for s in range(13, 0, -1):
        fits, have, count = small < small.dtype.type(1 << int(WIDTHS[s])) if most >> int(WIDTHS[s]) else np.ones(n, bool), 1, int(COUNTS[s])
        if count > n:
            break
        while have < count:  # runs of have values become runs of have + step
            step = min(have, count - have)
            fits = fits[:-step] & fits[step:]
            have += step
        if not fits.any():
            break
        chosen[: len(fits)][fits] = s
    return chosen


def _starts(chosen: np.ndarray) -> np.ndarray:
    """The values that begin a word: 0, and from each on the next by its selector's count.

    A step a word in plain Python takes a quarter of the time of numpy's jumps over all values.
    """
    n, starts, p, step = len(chosen), [], 0, bytes(COUNTS.tolist())
    at = chosen.tobytes().translate(step.ljust(256, b"\1"))
    while p < n:
        starts.append(p)
        p += at[p]
    return np.array(starts)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed words and raw words of an array of uint64."""
    v = np.ascontiguousarray(values, _U)
    if not len(v):
        return np.zeros(0, _U), np.zeros(0, _U)
    chosen = _selectors(v)
    first = _starts(chosen)
    kind = chosen[first]
    words = np.zeros(len(first), _U)
    for s in np.unique(kind):
        if s == 0:
            continue
        mine = np.flatnonzero(kind == s)
        at, word = first[mine], np.full(len(mine), _U(s) << _U(60))
        for lane in range(COUNTS[s]):
            word |= v[at + lane] << _U(lane * WIDTHS[s])
        words[mine] = word
    return words, v[first[kind == 0]]


def decode(words: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The values of encode()'s words."""
    words = np.asarray(words, _U)
    kind = (words >> _U(60)).astype(np.int64)
    counts = COUNTS[kind]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, _U)
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        begins = ends[mine] - counts[mine]
        if s == 0:
            out[begins] = raw
            continue
        lanes = np.arange(COUNTS[s])
        out[begins[:, None] + lanes] = (words[mine][:, None] >> (lanes * WIDTHS[s]).astype(_U)) & _U((1 << int(WIDTHS[s])) - 1)
    return out
