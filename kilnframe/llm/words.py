"""Hashes of the words of a text, for a whole text at once."""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POW[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def word_hashes(raw: bytes, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space, in order."""
    if len(raw) > block:  # at a white space, so that powers stay few
        out, a = [], 0
        while a < len(raw):
            b = a + block
            while b < len(raw) and not _SPACE[raw[b]]:
                b += 1
            out.append(_hashes(raw[a:b]))
            a = b
        return np.concatenate(out)
    return _hashes(raw)


def _hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; a shorter text is one run; without words there is none."""
    w = word_hashes(raw)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = mix(h + w[j : len(w) - k + 1 + j])
    return np.unique(h)
