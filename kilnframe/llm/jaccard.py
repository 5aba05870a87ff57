"""N-gram Jaccard join with Bayesian candidate pruning.

Documents of equal shingle sets are one class; a class is compared once.
MinHash bands bring classes together; a bucket of many is dealt into pairs of
blocks, so no task holds an unbounded bucket. A pair is compared in the first
band in which it meets, 16 MinHash values at a time, and dropped once the
posterior probability that its similarity reaches the threshold is below the
tolerance. What is left is verified on the shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free, saved, small_batches, texts, whole_groups
from .words import shingles

HASHES, BANDS, STEP, BLOCK = 128, 32, 16, 1024
_rng = np.random.default_rng(20240501)
_A = (_rng.integers(0, 2**63, HASHES, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, np.int64).astype(np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values of a set of hashes."""
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(h), 2048):
        out = np.minimum(out, (_A[:, None] * h[i : i + 2048] + _B[:, None]).min(1))
    return (out >> np.uint64(32)).astype("<u4")


def digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def needed(threshold: float, tolerance: float) -> list[int]:
    """After each ``STEP`` values, the fewest matches with which a pair goes on.

    With a uniform prior, the similarity after ``m`` matches of ``n`` reaches
    ``t`` with the probability that a binomial of ``n + 1`` and ``t`` is at most
    ``m``.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, cls, n, sig, th)``: equal ``cls`` means equal shingle sets; ``n`` is their size; ``th`` names the text."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, t in zip(pdf.doc_id, pdf.text):
                h = shingles(t.lower().encode(), width)
                out.append((i, digest(h), len(h), signature(h).tobytes() if len(h) else b"", hashlib.md5(t.encode()).digest()))
            yield pd.DataFrame(out, columns=["doc_id", "cls", "n", "sig", "th"])

    return texts(docs).mapInPandas(run, "doc_id long, cls binary, n long, sig binary, th binary")


def buckets(reps: DataFrame) -> DataFrame:
    """``(gid, more, band, id, side)``: classes to compare; ``gid`` and ``more`` are 128 bits that name a group. Equal buckets of several bands count once, under the first band."""

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mul = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5][: HASHES // BANDS], np.uint64)
        for pdf in it:
            if not len(pdf):
                continue
            s = np.frombuffer(b"".join(pdf.sig), "<u4").reshape(-1, BANDS, HASHES // BANDS).astype(np.uint64)
            k = ((s + np.uint64(1)) * mul).sum(2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)
            k = (k ^ (k >> np.uint64(31))) * mul[0]
            yield pd.DataFrame({"key": k.ravel().astype(np.int64), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(pdf)), "id": np.repeat(pdf.id.to_numpy(), BANDS)})

    rows = reps.select("id", "sig").mapInPandas(keys, "key long, band int, id long")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = rows.groupBy("key", "band").agg(F.count("*").alias("m")).where("m > 1")
    mine = rows.join(met, ["key", "band"]).withColumn("s", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), "s").cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("key", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.struct("id", (F.col("mine") == F.greatest("mine", "other")).cast("int").alias("side")).alias("x"))
    groups = dealt.groupBy("key", "band", "i", "j").agg(F.array_sort(F.collect_list("x")).alias("xs")).where("size(xs) > 1")
    # a block with itself has one side; two blocks have two
    once = groups.groupBy(F.xxhash64("xs", F.col("i") == F.col("j")).alias("gid"), F.xxhash64(F.lit(1), F.col("i") == F.col("j"), "xs").alias("more")).agg(F.min("band").alias("band"), F.first("xs").alias("xs"), F.first(F.col("i") < F.col("j")).alias("two"))
    return once.select("gid", "more", "band", "two", F.explode("xs").alias("x")).select("gid", "more", "band", "two", "x.id", "x.side")


def prune(threshold: float, tolerance: float):
    need = needed(threshold, tolerance)

    def group(g: pd.DataFrame) -> list[tuple]:
        ids, n, side = g.id.to_numpy(), g.n.to_numpy(), g.side.to_numpy()
        s = np.frombuffer(b"".join(g.sig), "<u4").reshape(len(g), HASHES)
        band, two = int(g.band.iloc[0]), bool(g.two.iloc[0])
        at = slice(band * (HASHES // BANDS), (band + 1) * (HASHES // BANDS))
        out: dict[int, list[int]] = {}
        seen = np.zeros(len(g), bool)
        for x in range(len(g) - 1):
            y = np.arange(x + 1, len(g))
            y = y[np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]) - 1e-9]
            if two:
                y = y[side[y] != side[x]]
            y = y[(s[y, at] == s[x, at]).all(1)]
            matches = np.zeros(len(y), np.int64)
            eq = s[y] == s[x]
            if band and len(y):
                earlier = eq[:, : at.start].reshape(len(y), band, -1).all(2).any(1)
                y, eq, matches = y[~earlier], eq[~earlier], matches[~earlier]
            for k, least in enumerate(need):
                if not len(y):
                    break
                matches = matches + eq[:, k * STEP : (k + 1) * STEP].sum(1)
                go = matches >= least
                y, eq, matches = y[go], eq[go], matches[go]
            if len(y):
                out[x] = ids[y].tolist()
                seen[y] = seen[x] = True
        return [(g.gid.iloc[0], g.more.iloc[0], ids[i], out.get(i, [])) for i in np.flatnonzero(seen).tolist()]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(it, "gid"):
            rows = []
            for _, g in pdf.sort_values(["gid", "more", "id"]).groupby(["gid", "more"], sort=False):
                if len(g) > 1:
                    rows += group(g)
            yield pd.DataFrame(rows, columns=["gid", "more", "id", "partners"])

    return run


def verify(threshold: float, width: int):
    """Exact similarities of the pairs of a group; one row for each class in it: what it is linked to, and the smallest id it reaches there."""

    def group(g: pd.DataFrame) -> list[tuple]:
        sets = [shingles(t.lower().encode(), width) for t in g.text]
        mine = np.array([digest(x) == bytes(c) for x, c in zip(sets, g.cls)])  # an id can have texts of other classes
        mine[mine] = ~g.id[mine].duplicated().to_numpy()
        sets, g = [x for x, m in zip(sets, mine) if m], g[mine]
        size = np.array([len(x) for x in sets])
        start = np.r_[0, np.cumsum(size)[:-1]]
        code = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
        flag = np.zeros(int(code.max()) + 1, np.int64)
        where = {i: k for k, i in enumerate(g.id.tolist())}
        copies, ids = g["copies"].to_numpy(), g.id.to_numpy()
        near: list[np.ndarray] = []
        links = np.zeros(len(g), np.int64)
        for x, partners in enumerate(g.partners):
            y = np.array([where[p] for p in partners], np.int64)
            if len(y):
                flag[code[start[x] : start[x] + size[x]]] = 1
                if len(y) * 4 > len(g):
                    both = np.add.reduceat(flag[code], start)[y]
                else:
                    both = np.array([flag[code[start[k] : start[k] + size[k]]].sum() for k in y.tolist()])
                flag[code[start[x] : start[x] + size[x]]] = 0
                y = y[both >= threshold * (size[x] + size[y] - both) - 1e-9]
                links[x] += copies[y].sum()
                links[y] += copies[x]
            near.append(y)
        root = np.arange(len(g))
        moved = True
        while moved:
            moved = False
            for x, y in enumerate(near):
                if len(y):
                    low = min(root[x], root[y].min())
                    if root[x] != low or (root[y] != low).any():
                        root[x], moved = low, True
                        root[y] = low
        low = {}
        for k in range(len(g)):
            low[root[k]] = min(low.get(root[k], ids[k]), ids[k])
        return [(ids[k], links[k], low[root[k]]) for k in range(len(g)) if links[k]]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(it, "gid"):
            rows = []
            for _, g in pdf.groupby(["gid", "more"], sort=False):
                rows += group(g)
            yield pd.DataFrame(rows, columns=["id", "links", "root"])

    return run


def _classed(docs: DataFrame, width: int, threshold: float, tolerance: float) -> DataFrame:
    """The columns of ``join``, and for each row its text's name ``th`` and the first ``(doc_id, th)`` of its class."""
    spark = docs.sparkSession
    small_batches(spark)
    sk = saved(sketches(docs, width))
    some = sk.where("n > 0")
    classes = some.groupBy("cls").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "th")).alias("row"))
    # an id with several texts stands for each of them by the least of their sets
    reps = saved(some.join(classes.withColumnRenamed("cls", "c"), (F.col("doc_id") == F.col("id")) & (F.col("cls") == F.col("c"))).select("id", "cls", "n", "sig", "copies", "row").dropDuplicates(["cls"]))
    # several classes can have the same smallest id if ids repeat; a class then goes by a number of its own
    reps = reps.withColumn("doc", F.col("id")).withColumn("id", F.xxhash64("cls"))
    pairs = buckets(reps).join(reps.select("id", "n", "sig"), "id")
    pruned = pairs.repartition("gid").sortWithinPartitions("gid").mapInPandas(prune(threshold, tolerance), "gid long, more long, id long, partners array<long>")
    pruned = saved(pruned)
    own = pruned.select("id").distinct().join(reps.select("id", "doc", "cls", "copies"), "id")
    held = texts(docs).join(own, F.col("doc_id") == F.col("doc")).select("id", "text", "copies", "cls")
    links = pruned.join(held, "id").repartition("gid").sortWithinPartitions("gid").mapInPandas(verify(threshold, width), "id long, links long, root long")
    links = saved(links)
    comp = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")), links.select("id"))
    low = comp.join(reps.select("id", "row"), "id")
    first = low.groupBy("component_id").agg(F.min("row").alias("first"))
    n = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = reps.select("id", "cls", "copies", "doc", "row").join(n, "id", "left").join(low.join(first, "component_id").select("id", "first"), "id", "left")
    known = known.select("cls", "copies", "doc", "links", F.coalesce("first", "row").alias("first"))
    out = sk.join(known, "cls", "left")
    return out.select(
        "doc_id",
        F.coalesce("first.doc_id", "doc_id").alias("class_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("doc", "doc_id").alias("copy_of"),
        "th",
        "first",
    )


def join(docs: DataFrame, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """One row for each row of ``docs`` that has a ``doc_id``.

    ``copy_of``: the smallest ``doc_id`` with the same set of ``width``-word
    shingles; ``n_links``: the other rows whose similarity is at least
    ``threshold``; ``class_id``: the smallest ``doc_id`` that links lead to.
    Words stand between ASCII white space, in lower case. A text of fewer words
    is one shingle; a text without words (null, empty) is linked to nothing. Rows
    that share an id are judged each by its own text, so they can be of
    different classes.

    A pair of similarity 0.8 meets in one of 32 bands of 4 values but for one in
    10 million, and is pruned wrongly with at most ``tolerance`` at each step.
    """
    return _classed(docs, width, threshold, tolerance).select("doc_id", "class_id", "n_links", "copy_of")


def query(docs: DataFrame) -> DataFrame:
    return join(docs)


def distinct(docs: DataFrame, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """The first row of each class, all columns: that of the smallest ``doc_id``, then of the smallest MD5 of its text.

    Of rows with equal id and text one is kept. Rows without a ``doc_id`` stay,
    and so do texts without words.
    """
    id_, gone_, own = free(docs.columns, "_id", "_gone", "_th")
    known = _classed(docs, width, threshold, tolerance)
    gone = known.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("th") != F.col("first.th"))).select(F.col("doc_id").alias(id_), F.col("th").alias(gone_)).distinct()
    th = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    kept = docs.withColumn(own, th).join(gone, (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(gone_)), "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))
    return kept


def sql(width: int = 5, threshold: float = 0.8) -> str:
    """All pairs that share a shingle, for DuckDB on a small table."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, CASE WHEN len(a) = 0 THEN 0 ELSE greatest(1, len(a) - {width} + 1) END), lambda i: array_to_string(a[i:i + {width} - 1], ' '))) AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT u, v, shared = len(a.g) AND shared = len(b.g) AS same FROM p JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE shared >= {threshold} * (len(a.g) + len(b.g) - shared) - 1e-9),
r AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT s.doc_id, (SELECT min(v) FROM r WHERE r.u = s.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.u = s.doc_id) AS n_links,
  least(s.doc_id, coalesce((SELECT min(v) FROM l WHERE l.u = s.doc_id AND same), s.doc_id)) AS copy_of FROM s"""
