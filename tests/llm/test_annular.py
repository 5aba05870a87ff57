"""Codes against a full search in Python's whole numbers, and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from kilnframe.llm import annular

DIR = "/root/testdata/sf0.001"


def full(rows, parts=8, entries=16, rounds=6):
    """The contract word by word: every part against every entry."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    if not kept:
        return []
    w = len(whole[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(p, c[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, of) if o == k]
                if mine:
                    books[p][k] = [sum(z) // len(mine) for z in zip(*mine)]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, l), e in zip(kept, error):
        by[l] = by.get(l, 0) + e
    sha = hashlib.sha256(",".join(str(z) for b in books for c in b for z in c).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by[l], sha) for (i, _, l), f, e in zip(kept, found, error)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def run(spark, rows):
    df = spark.createDataFrame([(i, v, l, 1.5, "clash") for i, v, l in rows], "vec_id long, embedding array<double>, label int, error double, code string").repartition(3)
    return ordered(tuple(r) for r in annular.query(df).collect())


@pytest.mark.parametrize("case", ["plain", "ties", "few", "odd", "large"])
def test_against_full_search(spark, case):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16)) * rng.lognormal(0, 1, (60, 1))
    if case == "ties":
        x = np.round(x / 3) / 4096 * 2  # many equal distances and repeated vectors
        x[10:30] = x[0]
    if case == "large":
        x = x * 2.0**34
    rows = [(int(k) * 3 - 50, v.tolist(), int(k) % 4 if k % 5 else None) for k, v in zip(rng.permutation(60), x)]
    if case == "few":
        rows = rows[:5]
    if case == "odd":
        rows += [(1000, None, 1), (1001, [1.0] * 15 + [math.nan], 1), (1002, [1.0] * 15 + [None], 1), (1003, [math.inf] * 16, 1), (1004, [], 1), (None, [0.5] * 16, 2), rows[3], rows[3], (1005, [0.0] * 16, None)]
    if case == "large":
        with pytest.raises(Exception):  # the sum of squares leaves 64 bits
            run(spark, [(i, (np.array(v) * 2**10).tolist(), l) for i, v, l in rows])
        rows = [(i, (np.array(v) / 2**20).tolist(), l) for i, v, l in rows]
    assert run(spark, rows) == ordered(full(rows))


def test_annulus_finds_what_a_full_search_finds():
    rng = np.random.default_rng(4)
    for top in (3, 1000, 1 << 28, 1 << 33):
        book, x = rng.integers(-top, top, (16, 8)), rng.integers(-top, top, (500, 8))
        book[5] = book[2]
        x[:20] = book[rng.integers(0, 16, 20)]
        near, d, compared = annular.nearest(x, book)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)), k) for k, c in enumerate(book)) for r in x]
        assert [(int(a), int(b)) for a, b in zip(d, near)] == want
    far = np.arange(1, 17)[:, None] * np.ones((1, 8), np.int64) * 1000
    assert annular.nearest(far[rng.integers(0, 16, 1000)] + rng.integers(-9, 9, (1000, 8)), far)[2] < 1000 * 3  # norms far apart: few are compared


def test_empty_and_lengths(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert annular.query(spark.createDataFrame([], kind)).count() == 0
    assert annular.query(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    with pytest.raises(ValueError):
        annular.query(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 8, 1)], kind))


def test_many_labels(spark, monkeypatch):
    rows = [(k, [float(k % 7), 1.0] * 8, k if k % 3 else None) for k in range(40)]
    monkeypatch.setattr(annular, "FEW_LABELS", 2)
    assert run(spark, rows) == ordered(full(rows))


def test_decode(spark):
    x = annular.whole(spark.read.parquet(f"{DIR}/embeddings.parquet"))
    books = annular.fit(x)
    back = {r.vec_id: r.embedding for r in annular.decode(annular.encode(x, books), books).collect()}
    err = {r.vec_id: r.error for r in annular.encode(x, books).collect()}
    for r in x.collect():
        assert sum((math.floor(4096 * a) - b) ** 2 for a, b in zip(back[r.vec_id], r.v)) == err[r.vec_id]


def test_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    got = annular.query(spark.read.parquet(f"{DIR}/embeddings.parquet")).toPandas()
    want = c.sql(annular.sql()).df()
    cols = list(want.columns)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want.values.tolist()))
