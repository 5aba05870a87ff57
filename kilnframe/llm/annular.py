"""Vectors as one byte for each part: codebooks of whole numbers, nearest entries by annular norm pruning.

Components become ``floor(4096 * x)`` and a vector is cut into equal parts. In
each round every task assigns its parts to the nearest entry and adds up the
parts of each entry; a round gives the driver one row for each entry of each
codebook, whatever the size of the table.

The nearest entry of a part is found among entries sorted by norm: by the
triangle inequality an entry at distance ``d`` or less has a norm within ``d``
of the part's. The entry of the nearest norm gives the first ``d``; a binary
search gives the interval of norms that it allows, ends included; only entries
in that annulus are compared exactly, in whole numbers, nearest norms first,
and the interval narrows with each better distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SAFE = 1 << 62
#: Labels whose sums are sent to every task; beyond it the sums are joined by a shuffle.
FEW_LABELS = 100_000


def whole(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """``(vec_id, label, v array<long>)`` of the vectors that take part, written to the shared folder.

    A vector that is null, empty, or holds a null or a component that is not
    finite takes no part. Rows without a ``vec_id`` and repeated rows stay. All
    vectors must have one length, a multiple of ``parts``, and components of
    less than 2**49, else this raises. Other columns are left out.
    """
    v = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("long") if "label" in vectors.columns else F.lit(None).cast("long")
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = x.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    out = saved(x.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v")))
    s = out.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if s.lo is not None and (s.lo != s.hi or s.lo % parts):
        raise ValueError(f"vectors have {s.lo} to {s.hi} components; one length, a multiple of {parts}, is needed")
    if s.top is not None and (s.top < 0 or s.top >= 1 << 61):
        raise ValueError("a component is too large for whole numbers of 64 bits")
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1).astype(np.float64))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The index of the nearest entry of ``book`` for each row of ``x``, its squared distance, and how many were compared.

    Ties go to the lower index. Numbers whose squares don't fit 64 bits are
    compared as Python's, which are exact at any size.
    """
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    top = int(max(np.abs(x).max(), np.abs(book).max()))
    if 4 * top * top * x.shape[1] >= SAFE:
        x, book = x.astype(object), book.astype(object)
    order = np.argsort(norms(book), kind="stable")
    sorted_ = book[order]
    ring, mine = norms(sorted_), norms(x)
    slack = 1e-9 * (mine + ring[-1]) + 1e-6  # norms are rounded, so the annulus is taken a little wider
    first = np.searchsorted(ring, mine)
    left, right = np.maximum(first - 1, 0), np.minimum(first, len(ring) - 1)
    start = np.where(np.abs(mine - ring[left]) <= np.abs(ring[right] - mine), left, right)
    d = x - sorted_[start]
    best, found = (d * d).sum(1), order[start]
    compared = len(x)
    lo, hi = start - 1, start + 1
    while True:
        # the next entry on either side, while it lies in the annulus that the best distance allows
        reach = np.sqrt(best.astype(np.float64)) + slack
        inner, outer = np.searchsorted(ring, mine - reach, "left"), np.searchsorted(ring, mine + reach, "right")
        down, up = lo >= inner, hi < outer
        if not (down.any() or up.any()):
            break
        for side, at, step in ((down, lo, -1), (up, hi, 1)):
            rows = np.flatnonzero(side)
            if len(rows):
                e = at[rows]
                d = x[rows] - sorted_[e]
                d = (d * d).sum(1)
                better = (d < best[rows]) | ((d == best[rows]) & (order[e] < found[rows]))
                best[rows[better]], found[rows[better]] = d[better], order[e[better]]
                at[rows] += step
                compared += len(rows)
    return found, best, compared


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    c = batch.column(column)
    n = len(c)
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 1), np.int64)


def _split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    w = x.shape[1] // parts
    return [x[:, p * w : (p + 1) * w] for p in range(parts)]


def first_books(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> list[np.ndarray]:
    """Each part's entries at the start: the parts of the smallest ids, ties by the vector; rows without an id come last."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # ``entries`` rows at most
    return _split(np.array([r.v for r in rows], np.int64).reshape(len(rows), -1), parts) if rows else []


def improved(vectors: DataFrame, books: Sequence[np.ndarray]) -> list[np.ndarray]:
    """One round: entries become the floor of the mean of the parts that are nearest to them; unused ones stay."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]
    sent = [b.copy() for b in books]

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width), object)
        n = np.zeros((parts, entries), np.int64)
        for batch in it:
            x = _matrix(batch, "v")
            if not len(x):
                continue
            for p, y in enumerate(_split(x, parts)):
                near, _, _ = nearest(y, sent[p])
                count = np.bincount(near, minlength=entries)
                n[p] += count
                order = np.argsort(near, kind="stable")
                used = np.flatnonzero(count)
                sums = y[order] if int(np.abs(y).max()) * len(y) < SAFE else y[order].astype(object)
                total[p, used] += np.add.reduceat(sums, np.r_[0, np.cumsum(count[used])[:-1]], axis=0).astype(object)
        at = [(p, e) for p in range(parts) for e in range(entries) if n[p, e]]
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([p for p, _ in at], pa.int32()),
                "entry": pa.array([e for _, e in at], pa.int32()),
                "n": pa.array([int(n[a]) for a in at], pa.int64()),
                "s": pa.array([[Decimal(int(z)) for z in total[a]] for a in at], pa.list_(pa.decimal128(38, 0))),
            }
        )

    part = vectors.select("v").mapInArrow(add, "part int, entry int, n long, s array<decimal(38,0)>")
    sums = part.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)])
    out = [b.copy() for b in books]
    for r in sums.collect():  # a row for each entry of each codebook
        out[r.part][r.entry] = [int(r[f"s{k}"]) // r.n for k in range(width)]
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of vectors as ``whole`` gives them; none for an empty table."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has one byte: 1 to 256 entries")
    books = first_books(vectors, entries, parts)
    for _ in range(rounds if books else 0):
        books = improved(vectors, books)
    return books


def encode(vectors: DataFrame, books: Sequence[np.ndarray]) -> DataFrame:
    """``(vec_id, label, code, error)``: the entry of each part as two hex digits, and the squared distances added up."""
    sent = [b.copy() for b in books]

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _matrix(batch, "v")
            if not len(x) or not sent:
                continue
            index, error = np.zeros((len(x), len(sent)), np.uint8), [0] * len(x)
            for p, y in enumerate(_split(x, len(sent))):
                near, d, _ = nearest(y, sent[p])
                index[:, p] = near
                error = [a + int(b) for a, b in zip(error, d.tolist())]
            raw, w = index.tobytes().hex(), 2 * len(sent)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array([raw[i * w : (i + 1) * w] for i in range(len(x))]), "error": pa.array(error, pa.int64())})

    return vectors.mapInArrow(code, "vec_id long, label long, code string, error long")


def decode(codes: DataFrame, books: Sequence[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``(vec_id, embedding)``: the vector that a code stands for, each component the middle of its step."""
    sent = [b.copy() for b in books]

    def back(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            index = [bytes.fromhex(c) for c in pdf["code"]]
            v = [((np.concatenate([b[k] for b, k in zip(sent, i)]) + 0.5) / scale).tolist() for i in index]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": v})

    return codes.where("vec_id is not null").select("vec_id", "code").mapInPandas(back, "vec_id long, embedding array<double>")


def fingerprint(books: Sequence[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(z)) for b in books for z in b.ravel()).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors of equal labels added up; rows without a label belong together.

    Sums are added up in each task before they move. Up to ``FEW_LABELS`` labels,
    which are counted, the sums go to every task; more are joined by a shuffle,
    in which Spark splits labels of many rows.
    """
    sums = saved(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of"))
    side = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return codes.join(side, F.col("label").eqNullSafe(F.col("_of")), "left").drop("_of")


def query(vectors: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of each vector that takes part; an empty table gives no rows."""
    x = whole(vectors)
    books = fit(x)
    codes = saved(encode(x, books))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows by a full comparison with every entry, for DuckDB; each round is a table of its own."""
    out = [
        f"""WITH w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM w, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {entries})"""
    ]
    dist = "list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) FOR i IN range(1, len(x.v) + 1)])"
    for k in range(rounds + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT r, part, min({{'d': CAST({dist} AS BIGINT), 'entry': entry}}) AS best FROM p x JOIN c{k} c USING (part) GROUP BY r, part)")
        if k < rounds:
            floored = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            out.append(
                f"""m{k} AS (SELECT part, entry, list({floored} ORDER BY i) AS v FROM (SELECT part, best.entry AS entry, i, sum(v[i]) AS s, count(*) AS n FROM a{k} JOIN p USING (r, part), (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"""
            )
    last = rounds
    out.append(f"e AS (SELECT r, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{last} GROUP BY r)")
    out.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last})")
    return ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM w JOIN e USING (r), h"
