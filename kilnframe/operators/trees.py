"""Trees, forests and boosting: one fit of the largest model answers for all smaller ones.

A tree cut at a depth is the tree of that depth, and the first trees of a
boosted ensemble are the ensemble of that size; the first trees of a forest are
a forest of that size (with bootstrap draws of their own, not those of a smaller
fit). So a grid is fitted only where models differ otherwise. The fitted nodes
become a table; a task walks all trees of all fits for its rows, adds their votes
up tree by tree, and returns counts of (candidate, split, label, predicted).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnframe.operators import models as M
from kilnframe.operators import prepare as P
from kilnframe.sources.shared import folder

NODES = "tree int, id int, depth int, prediction double, gain double, n double, left int, right int, feature int, threshold double, share array<double>"


class Tree(NamedTuple):
    """The nodes of one tree by id: children are -1 at a leaf; ``share`` is the part of each class among a node's rows."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    prediction: np.ndarray
    share: np.ndarray
    gain: np.ndarray
    n: np.ndarray
    depth: np.ndarray


class Fit(NamedTuple):
    """A fitted model: its trees and their weights. ``kind`` is ``tree``, ``forest`` or ``boosting``."""

    kind: str
    trees: list[Tree]
    weights: np.ndarray


def read(model, kind: str) -> Fit:
    """The nodes of a fitted ``pyspark.ml`` model, as it writes them; their number is bounded by trees and depth."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = folder(spark, "model")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if kind == "tree":
        data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
    by: dict[int, list] = {}
    for r in data.orderBy("treeID", "nodeData.id").collect():
        by.setdefault(r.treeID, []).append(r.nodeData)
    trees = []
    for t in sorted(by):
        nodes = by[t]
        left, right = (np.array([x[c] for x in nodes], np.int64) for c in ("leftChild", "rightChild"))
        stats = np.array([x.impurityStats for x in nodes], float)
        n = stats[:, 0] if kind == "boosting" else stats.sum(1)
        depth = np.zeros(len(nodes), np.int64)
        for i in range(len(nodes)):  # a child comes after its parent
            if left[i] >= 0:
                depth[[left[i], right[i]]] = depth[i] + 1
        share = stats / np.maximum(n, 1e-300)[:, None]
        trees.append(Tree(left, right, np.array([max(0, x.split.featureIndex) for x in nodes]), np.array([(x.split.leftCategoriesOrThreshold or [0.0])[0] for x in nodes], float), np.array([x.prediction for x in nodes], float), share, np.array([x.gain for x in nodes], float), n, depth))
    return Fit(kind, trees, np.array(model.treeWeights if kind == "boosting" else [1.0] * len(trees), float))


def node_table(spark, fit: Fit, deepest: int | None = None) -> DataFrame:
    """A row for each node, down to ``deepest`` levels below the root: a tree's picture as data."""
    rows = [
        (t, i, int(x.depth[i]), float(x.prediction[i]), float(x.gain[i]), float(x.n[i]), int(x.left[i]), int(x.right[i]), int(x.feature[i]) if x.left[i] >= 0 else None, float(x.threshold[i]) if x.left[i] >= 0 else None, x.share[i].tolist())
        for t, x in enumerate(fit.trees)
        for i in range(len(x.left))
        if deepest is None or x.depth[i] <= deepest
    ]
    return spark.createDataFrame(rows, NODES)


def importances(spark, fit: Fit, cols: Sequence[str]) -> DataFrame:
    """``(variable, importance, deviation, rank)``: gains by variable, each tree's adding up to 1, their mean and deviation over the trees."""
    per = np.zeros((len(fit.trees), len(cols)))
    for t, x in enumerate(fit.trees):
        inner = x.left >= 0
        np.add.at(per[t], x.feature[inner], x.gain[inner] * x.n[inner])
    total = per.sum(1, keepdims=True)
    per = np.divide(per, total, out=np.zeros_like(per), where=total > 0)
    mean = per.sum(0) / per.sum() if per.sum() else per.sum(0)
    order = sorted(range(len(cols)), key=lambda i: (-mean[i], cols[i]))
    return spark.createDataFrame([(cols[i], float(mean[i]), float(per[:, i].std()), k + 1) for k, i in enumerate(order)], "variable string, importance double, deviation double, rank int")


def _walk(x: Tree, v: np.ndarray, steps: int | None = None) -> Iterator[np.ndarray]:
    """Where the rows are after 0, 1, ... steps; rows at a leaf stay."""
    rows, at = np.arange(len(v)), np.zeros(len(v), np.int64)
    for _ in range(int(x.depth.max()) + 1 if steps is None else steps + 1):
        yield at
        down = np.where(v[rows, x.feature[at]] <= x.threshold[at], x.left[at], x.right[at])
        at = np.where(x.left[at] >= 0, down, at)


def predictions(fit: Fit, v: np.ndarray, sizes: Sequence[int]) -> Iterator[np.ndarray]:
    """The class of each row by the model of each size: depths of a tree, numbers of trees of an ensemble, both rising."""
    if fit.kind == "tree":
        paths = list(_walk(fit.trees[0], v, max(sizes)))
        for d in sizes:
            yield fit.trees[0].prediction[paths[d]].astype(np.int64)
        return
    total, done = None, 0
    for n in sizes:
        for t in range(done, min(n, len(fit.trees))):
            *_, leaf = _walk(fit.trees[t], v)
            add = fit.trees[t].share[leaf] if fit.kind == "forest" else fit.weights[t] * fit.trees[t].prediction[leaf]
            total = add if total is None else total + add
        done = n
        yield np.argmax(total, axis=1) if fit.kind == "forest" else (total > 0).astype(np.int64)


def counts(df: DataFrame, cols: Sequence[str], target: str, fits: Sequence[Fit], sizes: Sequence[int]) -> DataFrame:
    """``(fit, size, split, label, predicted, n)`` of every fit at every size, in one pass over the rows without a gap."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for batch in it:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            split, label = batch.column("split").to_pylist(), batch.column("label").to_pylist()
            group = {g: np.array([i for i, z in enumerate(zip(split, label)) if z == g]) for g in set(zip(split, label))}
            for f, fit in enumerate(fits):
                for n, best in zip(sizes, predictions(fit, v, sizes)):
                    for (s, y), rows in group.items():
                        for c, m in zip(*np.unique(best[rows], return_counts=True)):
                            total[f, n, s, y, int(c)] = total.get((f, n, s, y, int(c)), 0) + int(m)
        keys = list(total)
        names, types = ("fit", "size", "split", "label", "predicted"), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_pydict({c: pa.array([k[i] for k in keys], t) for i, (c, t) in enumerate(zip(names, types))} | {"n": pa.array([total[k] for k in keys], pa.int64())})

    x = P.whole(df, [target, *cols]).select("split", F.col(target).cast("long").alias("label"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    rows = x.mapInArrow(run, "fit int, size int, split string, label long, predicted long, n long")
    return rows.groupBy("fit", "size", "split", "label", "predicted").agg(F.sum("n").alias("n"))


def fitted(df: DataFrame, cols: Sequence[str], target: str, kind: str, grid: Sequence[dict], largest: int, seed: int = 42) -> list[Fit]:
    """A fit of the largest size for each point of ``grid``, all on one prepared set of training rows, which is released."""
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    kinds = {"tree": (DecisionTreeClassifier, "maxDepth"), "forest": (RandomForestClassifier, "numTrees"), "boosting": (GBTClassifier, "maxIter")}
    make, size = kinds[kind]
    train = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(df.where("split = 'train'")).where(F.col(target).isNotNull()).select("features", F.col(target).cast("double").alias("label")).persist()
    try:
        return [read(make(featuresCol="features", labelCol="label", seed=seed, **{size: largest}, **g).fit(train), kind) for g in grid]
    finally:
        train.unpersist()


def sized(fit: Fit, n: int) -> Fit:
    """The model of size ``n`` within a larger one: the first trees of an ensemble, or a tree cut at a depth, in which a split into equal predictions is no split."""
    if fit.kind != "tree":
        return fit._replace(trees=fit.trees[:n], weights=fit.weights[:n])
    (x,) = fit.trees
    left, right = (np.where(x.depth < n, c, -1) for c in (x.left, x.right))
    for i in range(len(left) - 1, -1, -1):  # a child comes after its parent
        if left[i] >= 0 and left[left[i]] < 0 and left[right[i]] < 0 and x.prediction[left[i]] == x.prediction[right[i]]:
            left[i] = right[i] = -1
    kept = np.arange(len(left)) == 0
    for i in range(len(left)):
        if kept[i] and left[i] >= 0:
            kept[[left[i], right[i]]] = True
    place = np.cumsum(kept) - 1
    child = lambda c: np.where(c >= 0, place[c], -1)[kept]
    return fit._replace(trees=[Tree(child(left), child(right), *[v[kept] for v in x[2:]])])


def search(df: DataFrame, cols: Sequence[str], target: str, kind: str, grid: Sequence[dict], sizes: Sequence[int], measure: str = "recall", seed: int = 42) -> tuple[DataFrame, Fit]:
    """The rows of ``models.studied`` for every point of ``grid`` at every size, and the winner at its size.

    If no candidate is a winner, as when all of them predict one class, the fit is
    that of the first candidate with the largest measure; no row is marked.

    Candidates go point by point, each from the smallest size up; the curve is
    that of the winner's point over all sizes, on both splits.
    """
    sizes = sorted(sizes)
    fits = fitted(df, cols, target, kind, grid, max(sizes), seed)
    by = {}
    for r in M.class_metrics(counts(df, cols, target, fits, sizes), "label", "predicted", ["fit", "size", "split"], "n").collect():  # candidates x 2
        by.setdefault((r.fit, r["size"]), {})[r.split] = {m: r[m] for m in M.MEASURES}
    what = {"tree": "maxDepth", "forest": "numTrees", "boosting": "maxIter"}[kind]
    order = [(f, n) for f in range(len(grid)) for n in sizes]
    rows = [(", ".join([*[f"{k}={v}" for k, v in grid[f].items()], f"{what}={n}"]), by.get((f, n), {})) for f, n in order]
    values = [g.get("test", {}).get(measure) for _, g in rows]
    at = M.best_of(values)
    table = M.studied(df.sparkSession, rows, lambda i: [r for r, o in zip(rows, order) if o[0] == order[i][0]], measure)
    if at is None:
        at = max(range(len(rows)), key=lambda i: (float("-inf") if values[i] is None else values[i], -i))
    return table, sized(fits[order[at][0]], order[at][1])
