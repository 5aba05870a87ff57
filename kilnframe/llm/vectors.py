"""What both vector operators need: clean vectors, and rotations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v array<double>, label)`` of the vectors that take part.

    A vector that is null, empty, all zero, or holds a null or a component that
    is not finite takes no part, nor does a row without an id. Repeated rows
    stay; the operators say what they make of them.
    """
    v = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("long") if "label" in vectors.columns else F.lit(None).cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), label.alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0.0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two, scaled to keep norms."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """A fast pseudo-rotation: three times random signs and a Hadamard transform, on rows padded to a power of two."""
    n = 1 << (x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], n))
    return y


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, each summed in the order of the components, so equal vectors have equal ones."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += a[:, j, None] * b[None, :, j]
    return out
