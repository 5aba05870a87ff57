"""Near-duplicate vectors by E8 lattice hashing.

Each table projects unit vectors to eight dimensions, shifts them at random and
decodes them to the nearest point of a scaled E8 lattice. A vector is kept in
its own cell and in the neighbouring cells that lie nearest to it. Two vectors
with equal labels meet in each cell that both are kept in and are compared
there, the ones near the threshold by cosine in double precision. A link counts
in the first cell of the pair only, so a cell gives a number of links and one
edge for each vector, not a row for each link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, small_batches
from .vectors import unit, usable

TABLES, PROBES, SCALE = 2, 5, 0.26
#: Components of the vectors that are one side of a comparison, and pairs that are looked at together.
BLOCK, TILE = 1 << 21, 1 << 21
#: No cell has these keys.
NO, NOR = -(2**31), -(2**31) + 1


@cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of one, or all of a half with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            r = np.zeros(8)
            r[i], r[j] = a, b
            out.append(r)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _d8(y: np.ndarray) -> np.ndarray:
    """The nearest integers with an even sum."""
    z = np.round(y)
    odd = z.sum(1) % 2 != 0
    off = y - z
    far = np.abs(off).argmax(1)
    r = np.arange(len(y))
    z[r, far] += np.where(odd, np.where(off[r, far] >= 0, 1.0, -1.0), 0.0)
    return z


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of D8 or of D8 moved by a half in each coordinate."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def _keys(z: np.ndarray, table: int) -> np.ndarray:
    c = np.round(2 * z).astype(np.int64).astype(np.uint64)
    h = np.full(len(c), np.uint64((table + 1) * 0x9E3779B97F4A7C15 % 2**64))
    for j in range(8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[:, j]
    return (h ^ (h >> np.uint64(32))).astype(np.int64)


def cells(x: np.ndarray, table: int, probes: int, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The key of each unit vector's own cell, and those of its ``probes`` nearest neighbouring cells."""
    rng = np.random.default_rng(90_000 + table)
    p = np.linalg.qr(rng.standard_normal((max(8, x.shape[1]), 8)))[0][: x.shape[1]]
    y = x @ p / scale * np.sqrt(x.shape[1] / 64.0) + rng.random(8)
    z = decode(y)
    off = y - z
    near = np.argpartition(-(off @ roots().T), probes - 1, axis=1)[:, :probes]
    around = z[:, None, :] + roots()[near]
    return _keys(z, table), _keys(around.reshape(-1, 8), table).reshape(len(x), probes)


def kept_in(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """The keys of all cells that each unit vector is kept in, 32 bits each, in order; vectors of another length have other ones."""
    both = [np.column_stack(cells(x, t, probes)) for t in range(tables)]
    k = np.concatenate(both, 1) + x.shape[1]
    return np.sort(np.maximum((k ^ (k >> 32)).astype(np.int32), np.int32(NOR + 1)), axis=1)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in single precision if that holds it exactly, else in double; a letter before it says which."""
    x = x + 0.0
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    fine = (small == x).all(1)
    return [b"f" + s.tobytes() if f else b"d" + r.tobytes() for f, s, r in zip(fine, small, x)]


def unpacked(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, matrix)`` of the vectors of each length."""
    v = v.cast(pa.binary())
    ends, data = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1], np.frombuffer(v.buffers()[2], np.uint8)
    double = data[ends[:-1]] == ord("d")
    dims = (np.diff(ends) - 1) // np.where(double, 8, 4)
    for dim in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == dim)
        x = np.empty((len(mine), dim))
        for at in range(0, len(mine), 1024):
            part = mine[at : at + 1024]
            for kind, rows in ((np.float32, ~double[part]), (np.float64, double[part])):
                where = ends[part[rows], None] + 1 + np.arange(dim * kind().itemsize)
                x[at : at + 1024][rows] = data[where].view(kind)
        yield mine, x


def _first(a: np.ndarray, b: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which pairs have no cell in common among the columns of ``a`` and of ``b``."""
    out = np.ones(len(q), bool)
    for at in range(0, len(q), 1 << 16):
        part = slice(at, at + (1 << 16))
        x, y = np.ascontiguousarray(a[q[part]].T), np.ascontiguousarray(b[p[part]].T)
        for i in x:
            for j in y:
                out[part] &= i != j
    return out


def _joined(low: np.ndarray, q: np.ndarray, p: np.ndarray) -> None:
    """``low`` has the smallest place that each place is joined to; the pairs ``(q, p)`` are joined too."""
    while True:
        a, b = low[q], low[p]
        apart = a != b
        if not apart.any():
            return
        q, p, a, b = q[apart], p[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low[:] = low[low]


class Compared:
    """The vectors of one length in a cell: exact links of those that have no cell before it in common."""

    def __init__(self, x: np.ndarray, lists: np.ndarray, cell: int, threshold: float):
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
        self.x, self.norm, self.threshold = x, np.sqrt((x * x).sum(1)), threshold
        self.rough = (x / self.norm[:, None]).astype(np.float32)
        #: what single precision may add to a cosine or take from it
        self.error = 2 * (x.shape[1] + 8) * 2.0**-24
        #: the cells before this one
        self.a, self.b = (np.where(lists < cell, lists, np.int32(no)) for no in (NO, NOR))

    def _exact(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        for at in range(0, len(q), 4096):
            i, j = q[at : at + 4096], p[at : at + 4096]
            for u, v in zip(self.x[i].T, self.x[j].T):
                out[at : at + 4096] += u * v
        return out / self.norm[q] / self.norm[p]

    def links(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the linked pairs, some at a time: of ``left`` and ``right``, or each pair of ``left`` once if both are the same."""
        same = left is right
        at = 0
        while at < len(left):
            others = right[at:] if same else right
            mine = left[at : at + max(1, TILE // max(1, len(others)))]
            c = self.rough[mine] @ self.rough[others].T
            flat = np.flatnonzero(c >= np.float32(self.threshold - 2 * self.error))
            i, j = np.divmod(flat, len(others))
            if same:
                i, j, flat = (k[j > i] for k in (i, j, flat))
            q, p, sure = mine[i], others[j], c.ravel()[flat] > self.threshold + 2 * self.error
            sure[~sure] = self._exact(q[~sure], p[~sure]) >= self.threshold
            q, p = q[sure], p[sure]
            first = _first(self.a, self.b, q, p)
            if first.any():
                yield q[first], p[first]
            at += len(mine)


FOUND = "cid long, other long, n long"


def _verified(threshold: float):
    """A function for ``mapInArrow`` over rows sorted by ``cell``, ``label``, ``i`` and ``j``.

    For each vector of a cell that has links there: their number ``n`` and the
    first vector ``other`` that they lead to in the cell. Links of a vector
    whose ids have several contents come one by one, with an ``n`` of 0.
    """

    def group(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        t = t.combine_chunks()
        cid, copies, many, mine = (t.column(c).to_numpy() for c in ("cid", "copies", "many", "mine"))
        cell, i, j = (t.column(c)[0].as_py() for c in ("cell", "i", "j"))
        lists = t.column("cells").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        for rows, x in unpacked(t.column("v").combine_chunks()):
            ids, n, low = cid[rows], np.zeros(len(rows), np.int64), np.arange(len(rows))
            left = np.flatnonzero(mine[rows] == i)
            right = left if i == j else np.flatnonzero(mine[rows] == j)
            for q, p in Compared(x, lists[rows], cell, threshold).links(left, right):
                for u, v in ((q, p), (p, q)):
                    n += np.bincount(u, copies[rows[v]], len(n)).astype(np.int64)
                _joined(low, q, p)
                several = many[rows[q]] | many[rows[p]]
                if several.any():
                    u, v = ids[q[several]], ids[p[several]]
                    yield np.r_[u, v], np.r_[v, u], np.zeros(2 * len(u), np.int64)
            some = n > 0
            yield ids[some], ids[low[some]], n[some]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, out, size = None, [], 0

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["cid", "other", "n"])

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if sum(b.num_rows for b in held) > 1:
                for found in group(pa.Table.from_batches(held)):
                    out.append(found)
                    size += len(found[0])
                    if size > 1 << 16:
                        yield ready()
                        out.clear()
                        size = 0
            held.clear()

        for batch in it:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "label", "i", "j")])
            starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if now is not None and (key[a] != now).any():
                    yield from done()
                now = key[a]
                held.append(batch.slice(a, b - a))
        yield from done()
        if size:
            yield ready()

    return run


def link(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Contract of ``op7``: one row for each row of ``vectors`` that has a ``vec_id``.

    Equal vectors of one label are found as such and compared once. A vector
    that takes no part (see ``usable``), or whose label is null, has no links.
    Rows that share an id are one vector with each of its contents: it links
    with each other id that one of them meets, once, and joins what they reach.
    Vectors of different lengths are never linked.

    Two vectors of cosine 0.93 in random directions have no cell in common in
    one of 500,000 cases. A cell of more than ``BLOCK`` components is dealt into
    pairs of blocks.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    every = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            flat, n = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
            out, start = np.empty(len(n), object), np.r_[0, np.cumsum(n)[:-1]]
            for dim in np.unique(n).tolist():
                mine = np.flatnonzero(n == dim)
                out[mine] = packed(flat[start[mine, None] + np.arange(dim)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out.tolist(), pa.binary())], ["vec_id", "label", "v"])

    rows = usable(vectors).where("label is not null").select("vec_id", "label", "v").mapInArrow(pack, "vec_id long, label long, v binary")
    rows = rows.withColumn("cid", F.xxhash64("label", "v"))
    member = saved(rows.select("vec_id", "cid").distinct())
    several = member.groupBy("vec_id").agg(F.count("*").alias("n"), F.min("cid").alias("low")).where("n > 1")
    several = saved(member.join(several, "vec_id").select("vec_id", "cid", "low"))  # ids with more than one content
    marked = several.select("cid", F.lit(True).alias("many")).distinct()
    classes = member.groupBy("cid").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).join(marked, "cid", "left")
    classes = rows.select("cid", "label", "v").dropDuplicates(["cid"]).join(classes, "cid")
    classes = saved(classes.withColumn("many", F.coalesce("many", F.lit(False))))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            lists = np.empty((batch.num_rows, tables * (probes + 1)), np.int32)
            for mine, x in unpacked(batch.column("v")):
                lists[mine] = kept_in(unit(x), tables, probes)
            ends = np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.ravel()))], [*batch.schema.names, "cells"])

    placed = classes.select("cid", "label", "v", "copies", "many").mapInArrow(place, "cid long, label long, v binary, copies long, many boolean, cells array<int>")
    placed = placed.withColumn("cell", F.explode(F.array_distinct("cells")))
    longest = classes.agg(F.max(F.length("v"))).first()[0] or 1
    most = max(256, 4 * BLOCK // longest)
    large = saved(placed.groupBy("cell", "label").count().where(F.col("count") > most).select("cell", "label", F.ceil(F.col("count") / most).cast("int").alias("s")))
    dealt = placed.join(large, ["cell", "label"], "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("cid"), "s").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    by = ("cell", "label", "i", "j")
    found = dealt.select(*by, "mine", "cid", "copies", "many", "cells", "v").repartition(*by).sortWithinPartitions(*by).mapInArrow(_verified(threshold), FOUND)
    found = saved(found)

    # links whose ids are looked at one by one, and the classes with themselves
    meets = found.where("n = 0").select(F.col("cid").alias("u"), F.col("other").alias("v")).union(marked.select(F.col("cid").alias("u"), F.col("cid").alias("v")))
    twice = several.select(F.col("cid").alias("v"), F.col("vec_id").alias("other"))

    def over(unit: DataFrame, by: str) -> DataFrame:
        """How often other ids are counted more than once among the members of the classes that a unit meets."""
        return unit.join(twice, "v").groupBy(by, "other").agg((F.count("*") - 1).alias("more")).groupBy(by).agg(F.sum("more").alias("more"))

    ids = several.join(meets, F.col("cid") == F.col("u")).select("vec_id", "v").distinct()
    counts = classes.select(F.col("cid").alias("v"), "copies")
    all_links = ids.join(counts, "v").groupBy("vec_id").agg(F.sum("copies").alias("n")).join(over(ids, "vec_id"), "vec_id", "left")
    all_links = all_links.select("vec_id", (F.col("n") - F.coalesce("more", F.lit(0)) - 1).alias("all_links"))
    shared = several.where("cid <> low").select(F.col("cid").alias("u"), F.col("low").alias("v"))
    comp = components(found.select(F.col("cid").alias("u"), F.col("other").alias("v")).union(shared)).withColumnRenamed("id", "cid")
    first = comp.join(classes.select("cid", "id"), "cid").groupBy("component_id").agg(F.min("id").alias("low"))
    of_class = classes.select("cid", "id", "copies").join(found.groupBy("cid").agg(F.sum("n").alias("n")), "cid", "left").join(over(meets, "u").withColumnRenamed("u", "cid"), "cid", "left")
    of_class = of_class.join(comp.join(first, "component_id").select("cid", "low"), "cid", "left")
    of_class = of_class.select("cid", (F.col("copies") - 1 + F.coalesce("n", F.lit(0)) - F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("low", "id").alias("low"))
    got = member.join(of_class, "cid").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("low").alias("component_id")).join(all_links, "vec_id", "left")
    out = every.join(got, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("all_links", "n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def query(vectors: DataFrame) -> DataFrame:
    return link(vectors)
