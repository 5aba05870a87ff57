"""Nearest neighbours by cross-polytope hashing.

Stored vectors are indexed apart by ranges of their norms, a third of an octave
each, so that within a range the largest inner products are nearly those of the
smallest angles; a query probes every range. A table turns unit vectors by three
fast pseudo-rotations; the nearest signed axis of each joins to a code, so 64
dimensions have up to 128 x 128 x 128 cells; the second and third use as many of
their axes as a range has vectors to fill the cells. A query probes in each
table the cells whose axes are nearest to it together, a share of all cells that
falls with about the root of their number. Cells are
dealt into blocks by their own counts, whole cells while they are small; a query
goes once to each block that has vectors of its cells. A block scores the
queries with the vectors of the cells they probe, on the original components,
and passes on its best. The best of all blocks, each vector once, are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, small_batches, whole_groups
from .vectors import products, rotated, unit, usable

TABLES, PROBES, BLOCK = 14, 14, 4000
#: The second axes are doubled in number while cells would hold so many vectors on average.
FILL = 2
#: So many of a rotation's nearest axes are joined to the other's.
AXES = 24
BEST = "query_id long, ids array<long>, scores array<double>"


#: Vectors are indexed by norm in ranges of a third of an octave below the largest; the last range holds all that is smaller.
RANGES = 16


def second_axes(n: int, dim: int) -> int:
    """How many cells a first axis is divided into for ``n`` vectors: axes of the second rotation, and when all are used, pairs of them and axes of the third."""
    whole = 2 << (dim - 1).bit_length()
    m = 1
    while 2 * m * whole * FILL <= n and m < whole * whole:
        m *= 2
    return m


def ranges(norm: np.ndarray, largest: float) -> np.ndarray:
    """The range of each norm: 0 for the largest, rounded, so that norms equal but for rounding share one."""
    return np.clip(np.rint(-3.0 * np.log2(norm / largest)), 0, RANGES - 1).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1)
    return np.linalg.norm(x / top[:, None], axis=1) * top


def _signed(x: np.ndarray, table: int, second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unit vector's closeness to the signed axes of a table's three rotations."""
    whole = 2 << (x.shape[1] - 1).bit_length()
    a, b, c = (rotated(x, seed) for seed in (7_000 + 2 * table, 7_001 + 2 * table, 70_000 + table))
    b = b[:, : min(second, whole) // 2]
    c = c[:, : second // whole // 2]
    both = lambda y: np.concatenate([y, -y], 1) if y.shape[1] else np.zeros((len(y), 1))
    return both(a), both(b), both(c)


def _top(s: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest in each row, largest first, ties to the first."""
    k = min(k, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(s), 1))
    top.sort(1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def own_cells(x: np.ndarray, table: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest axis of each vector, and the number of its cell there: nearest axes of the second and third rotation."""
    a, b, c = _signed(x, table, second)
    return a.argmax(1), b.argmax(1) * c.shape[1] + c.argmax(1)


def probed_cells(x: np.ndarray, table: int, second: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells with the largest sums of closeness: ``probes``, and more as cells get more."""
    if len(x) > 256:
        parts = [probed_cells(x[i : i + 256], table, second, probes) for i in range(0, len(x), 256)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    a, b, c = _signed(x, table, second)
    probes = int(probes * second**0.49)
    j, k = _top(b, AXES), _top(c, AXES)
    inner = np.take_along_axis(b, j, 1)[:, :, None] + np.take_along_axis(c, k, 1)[:, None, :]
    cell = (j[:, :, None] * c.shape[1] + k[:, None, :]).reshape(len(x), -1)
    inner = inner.reshape(len(x), -1)
    best = _top(inner, 8 * AXES)  # pairs of axes, from the closest down
    inner, cell = np.take_along_axis(inner, best, 1), np.take_along_axis(cell, best, 1)
    i = _top(a, 2 * AXES)
    m = cell.shape[1]
    both = np.take_along_axis(a, i, 1)[:, :, None] + inner[:, None, :]
    p = _top(both.reshape(len(x), -1), probes)
    return np.take_along_axis(i, p // m, 1), np.take_along_axis(cell, p % m, 1)


def _placed(largest: dict[int, float], sizes: dict[tuple[int, int], int], tables: int, probes: int):
    """``(cell, axis, vec_id, v)`` for each cell of a vector; ``cell`` names dimension, table, range of norms and first axis. Probed cells of a first axis come as one list; every range is probed."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for dim, g in pdf.groupby("dim"):
                dim, v, ids = int(dim), g.v.to_numpy(), g.vec_id.to_numpy()
                raw = np.stack(v).astype(np.float64)
                x, mine = unit(raw), ranges(norms(raw), largest[dim])
                for (d, part), n in sizes.items():
                    rows = np.flatnonzero(mine == part) if not probes else np.arange(len(x))
                    if d != dim or not len(rows):
                        continue
                    second = second_axes(n, dim)
                    for t in range(tables):
                        base = (dim << 40) + (t << 32) + (part << 28)
                        if not probes:
                            i, j = own_cells(x[rows], t, second)
                            yield pd.DataFrame({"cell": base + i, "axis": j.astype(np.int32), "vec_id": ids[rows], "v": v[rows]})
                            continue
                        i, j = probed_cells(x, t, second, probes)
                        out = [(base + int(first), j[r][i[r] == first], ids[r], v[r]) for r in range(len(x)) for first in np.unique(i[r])]
                        yield pd.DataFrame(out, columns=["cell", "axes", "vec_id", "v"])

    return run


def _sizes(all_: DataFrame) -> tuple[dict[int, float], dict[tuple[int, int], int]]:
    """The largest norm of each length of vectors, and how many vectors each range of norms has; a few numbers a length."""

    def top(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for dim, g in pdf.groupby("dim"):
                yield pd.DataFrame({"dim": [int(dim)], "norm": [norms(np.stack(g.v.to_numpy()).astype(np.float64)).max()]})

    largest = {r.dim: r.norm for r in all_.select("v", "dim").mapInPandas(top, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm")).collect()}

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for dim, g in pdf.groupby("dim"):
                part, n = np.unique(ranges(norms(np.stack(g.v.to_numpy()).astype(np.float64)), largest[int(dim)]), return_counts=True)
                yield pd.DataFrame({"dim": int(dim), "part": part, "n": n})

    found = all_.select("v", "dim").mapInPandas(count, "dim int, part int, n long").groupBy("dim", "part").agg(F.sum("n").alias("n")).collect()
    return largest, {(r.dim, r.part): r.n for r in sorted(found, key=lambda r: (r.dim, r.part))}


def _nearest(own: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, lists: list[np.ndarray] | None, axis: np.ndarray | None, k: int) -> pd.DataFrame:
    """The ``k`` best of a block for each query: of all its vectors, or of those whose axis is in the query's list."""
    out = []
    if lists is None:
        for i in range(0, len(a), 256):
            s = products(a[i : i + 256], b)
            s[own[i : i + 256, None] == ids[None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            v = np.take_along_axis(s, top, 1)
            out += [(q, ids[t[w > -np.inf]], w[w > -np.inf]) for q, t, w in zip(own[i : i + 256], top, v)]
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    o = np.argsort(axis, kind="stable")
    sorted_ = axis[o]
    size = np.array([len(x) for x in lists])
    every = np.concatenate(lists)
    low, high = np.searchsorted(sorted_, every), np.searchsorted(sorted_, every, "right")
    n = high - low
    place = o[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    query = np.repeat(np.repeat(np.arange(len(lists)), size), n)
    go = ids[place] != own[query]
    place, query = place[go], query[go]
    s = np.zeros(len(place))
    for c in range(0, len(place), 200_000):
        for d in range(len(at)):
            s[c : c + 200_000] += at[d][query[c : c + 200_000]] * bt[d][place[c : c + 200_000]]
    by = np.lexsort((ids[place], -s, query))
    query, place, s = query[by], place[by], s[by]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    for f, e in zip(first, np.r_[first[1:], len(query)]):
        e = min(e, f + k)
        out.append((own[query[f]], ids[place[f:e]], s[f:e]))
    return pd.DataFrame(out, columns=["query_id", "ids", "scores"])


def _best(rows: DataFrame, k: int) -> DataFrame:
    """``rows(block, vec_id, v, axis, axes)``: a row with neither null is a query that probes ``axes``; without either it is compared with all of the block."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(it, "block"):
            for _, g in pdf.groupby("block", sort=False):
                a, b = g[g.q], g[~g.q]
                if not len(a) or not len(b):
                    continue
                b = b.sort_values("vec_id", kind="stable")
                lists = None if a["axes"].iloc[0] is None else [np.asarray(x) for x in a["axes"]]
                stacked = (np.stack(x.v.to_numpy()).astype(np.float64) for x in (a, b))
                yield _nearest(a.vec_id.to_numpy(), next(stacked), b.vec_id.to_numpy(), next(stacked), lists, b["axis"].to_numpy(), k)

    return rows.repartition("block").sortWithinPartitions("block").mapInPandas(run, BEST)


def _merged(best: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all blocks: ``query_id, rank, vec_id, score``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(it, "query_id"):
            query = np.repeat(pdf.query_id.to_numpy(), pdf.ids.map(len))
            ids, s = np.concatenate(pdf.ids.to_numpy()), np.concatenate(pdf.scores.to_numpy())
            o = np.lexsort((-s, ids, query))  # an id once, by its best row
            one = o[np.r_[True, (query[o][1:] != query[o][:-1]) | (ids[o][1:] != ids[o][:-1])]]
            o = one[np.lexsort((ids[one], -s[one], query[one]))]
            query, ids, s = query[o], ids[o], s[o]
            first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) + 1
            yield pd.DataFrame({"query_id": query, "rank": rank, "vec_id": ids, "score": s})[rank <= k]

    return best.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(run, "query_id long, rank int, vec_id long, score double")


def candidates(vectors: DataFrame, is_query: F.Column, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The vectors that take part, and ``(block, vec_id, v, axis, axes, q)``: what meets in each block.

    Cells of one first axis are packed in the order of the second while a block
    has room for them; a larger cell has blocks of its own, among which its
    vectors are dealt by a hash. The counts of the cells are at most as many as
    tables times cells, whatever the number of vectors.
    """
    kind = vectors.schema["embedding"].dataType  # components travel as they came and become doubles where they are used
    all_ = saved(usable(vectors).select("vec_id", F.col("v").cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.size("v").alias("dim")))
    v, (largest, sizes) = kind.simpleString(), _sizes(all_)
    index = all_.select("vec_id", "v", "dim").mapInPandas(_placed(largest, sizes, tables, 0), f"cell long, axis int, vec_id long, v {v}")
    asked = all_.where("q").select("vec_id", "v", "dim").mapInPandas(_placed(largest, sizes, tables, probes), f"cell long, axes array<int>, vec_id long, v {v}")
    counts = all_.select("vec_id", "v", "dim").mapInPandas(_placed(largest, sizes, tables, 0), f"cell long, axis int, vec_id long, v {v}").groupBy("cell", "axis").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("cell").orderBy("axis").rowsBetween(Window.unboundedPreceding, -1))
    s = F.ceil(F.col("m") / block).cast("int")
    turn = F.when(s > 1, -1 - F.col("axis")).otherwise(F.floor(F.coalesce(before, F.lit(0)) / block).cast("int"))
    cells = saved(counts.select("cell", "axis", turn.alias("turn"), s.alias("s")))
    name = lambda salt: F.xxhash64("cell", "turn", salt).alias("block")
    mine = index.join(cells, ["cell", "axis"]).select(name(F.pmod(F.xxhash64("vec_id"), "s")), "vec_id", "v", "axis", F.lit(None).cast("array<int>").alias("axes"), F.lit(False).alias("q"))
    # a query goes to the blocks of its cells, once each
    probe = asked.select("cell", "vec_id", "axes", F.explode("axes").alias("axis")).join(cells, ["cell", "axis"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s").cast("bigint") - 1)))
    to = probe.groupBy("cell", "vec_id", name("salt")).agg(F.collect_set("axis").alias("axes"))
    ours = to.join(all_.where("q").select("vec_id", "v"), "vec_id").select("block", "vec_id", "v", F.lit(None).cast("int").alias("axis"), "axes", F.lit(True).alias("q"))
    return all_, mine.unionByName(ours)


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest of all other vectors that were found.

    ``score`` is the inner product in double precision; ties go to the smaller
    ``vec_id``. Vectors are compared with those of their own length only. If
    the probed cells hold fewer than ``k`` vectors, the query is scored against
    all vectors, block by block. An empty table gives no rows. Repeated ids: a
    query meets no row of its own id, each of its rows asks for it, and an id
    ranks once, by its best row.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    all_, rows = candidates(vectors, is_query, tables, probes, block)
    best = saved(_best(rows, k))
    # the exact way for queries whose cells are too empty
    enough = best.select("query_id", F.explode("ids").alias("id")).groupBy("query_id").agg(F.count_distinct("id").alias("m")).where(F.col("m") >= k)
    few = saved(all_.where("q").select(F.col("vec_id").alias("query_id")).distinct().join(enough, "query_id", "left_anti"))
    if few.limit(1).count():
        late = all_.where("q").join(few.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_semi")
        n = all_.count()
        whole = max(1, round(n / block))
        nothing = [F.lit(None).cast("int").alias("axis"), F.lit(None).cast("array<int>").alias("axes")]
        i2 = all_.select(F.xxhash64("dim", F.pmod(F.xxhash64("vec_id"), F.lit(whole)).cast("int")).alias("block"), "vec_id", "v", *nothing, F.lit(False).alias("q"))
        salted = late.select("dim", F.explode(F.sequence(F.lit(0), F.lit(whole - 1))).alias("salt"), "vec_id", "v")
        a2 = salted.select(F.xxhash64("dim", "salt").alias("block"), "vec_id", "v", *nothing, F.lit(True).alias("q"))
        best = best.unionByName(_best(i2.unionByName(a2), k))
    return _merged(best, k)


def query(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0)
