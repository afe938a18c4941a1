"""Hashes of words and word shingles for whole batches of texts, in NumPy inside Spark tasks.

Words are runs of bytes other than blank, tab, \\n, \\v, \\f and \\r of the UTF-8 text, with A-Z lower-cased;
texts are never decoded. All hashes are the same in every process.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _STEP
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mix64(np.arange(256, dtype=_U))
_CODE[65:91] = _CODE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 20), base, _U)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=_U)
    return _powers[key][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and where each text's words begin and end (len(texts) + 1 offsets)."""
    if not texts:
        return np.zeros(0, _U), np.zeros(1, np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_CODE[raw] * _power(_BASE, len(raw)), dtype=_U, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _power(_INVERSE, len(raw))[starts] + (ends - starts).astype(_U))
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return hashes, np.searchsorted(starts, begin).astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every n-word shingle; a text with fewer words has one shingle of all of them, one with none has none."""
    counts = np.diff(offsets)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    if not len(words):
        return np.zeros(0, _U), out
    full = counts >= n
    total = np.zeros(len(words), _U)
    padded = np.concatenate([words, np.zeros(n, _U)])
    for k in range(n):
        total = total * _U(_BASE) + padded[k : k + len(words)]
    start = np.repeat(offsets[:-1] - out[:-1], per) + np.arange(out[-1])
    shingles = total[start]
    for i in np.flatnonzero(~full & (counts > 0)):
        short = np.zeros(1, _U)  # an array, as scalars warn when they wrap around
        for k in range(offsets[i], offsets[i + 1]):
            short = short * _U(_BASE) + words[k : k + 1]
        shingles[out[i]] = (short * _U(_BASE) + counts[i : i + 1].astype(_U))[0]
    return mix64(shingles), out
