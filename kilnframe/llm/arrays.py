"""Arrays as bytes, for rows that travel packed."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*columns: tuple[np.ndarray, str]) -> bytes:
    """Columns of any lengths: the numbers' first bytes, then their second bytes, and so on, as alike bytes together compress."""
    out = []
    for a, t in columns:
        b = np.ascontiguousarray(np.asarray(a).astype(t, copy=False))
        out += [struct.pack("<Q", len(b)), np.ascontiguousarray(b.view(np.uint8).reshape(len(b), -1).T) if len(b) else b""]
    return zstandard.compress(b"".join(out), 1)


def unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    """The first columns of ``pack``, as many as ``types``."""
    raw, at, out = zstandard.decompress(raw), 0, []
    for t in types:
        n, size = struct.unpack_from("<Q", raw, at)[0], np.dtype(t).itemsize
        b = np.empty((n, size), np.uint8)
        for k, plane in enumerate(np.frombuffer(raw, np.uint8, n * size, at + 8).reshape(size, n)):
            b[:, k] = plane
        out.append(b.view(t).ravel())
        at += 8 + n * size
    return out


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
