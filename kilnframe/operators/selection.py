"""Scores of many sets of variables at once: what each variable adds is computed once and added up by set.

Log likelihoods of naive Bayes and squared distances are sums over variables. A
task computes the terms of all variables for its rows, multiplies them by the
table of sets, and returns counts of (set, split, label, predicted); the search
for neighbours does the same with distances. So one pass serves every threshold
of a study, not a fit and a prediction for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnframe.operators import models as M
from kilnframe.operators import stats as T

KS = (1, 5, 10, 15, 20, 25)
Sets = Mapping[str, Sequence[str]]


def naive_bayes_sets(df: DataFrame, cols: Sequence[str], target: str, sets: Sets, kind: str = "gaussian", smoothing: float = 1e-9, alpha: float = 1.0) -> DataFrame:
    """``(set, split, label, predicted, n)``: how a naive Bayes on each set of variables predicts all rows.

    ``gaussian`` adds ``smoothing`` times the set's largest variance to all
    variances; ``bernoulli`` asks whether a value is above 0, with ``alpha`` added
    to the counts. Fitted is one aggregation of the ``train`` rows: a row for each
    class. A missing value adds nothing; ties go to the smaller label.
    """
    at = {c: i for i, c in enumerate(cols)}
    x = [F.col(c).cast("double") for c in cols]
    t = df.where((F.col("split") == "train") & F.col(target).isNotNull())
    per = t.groupBy(F.col(target).cast("long").alias("class")).agg(F.count("*").alias("n"), F.array(*[F.count(c) for c in x]).alias("k"), F.array(*[F.avg(c) for c in x]).alias("mu"), F.array(*[F.var_pop(c) for c in x]).alias("var"), F.array(*[F.sum((c > 0).cast("double")) for c in x]).alias("up")).orderBy("class").collect()
    numbers = lambda rows: np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(per), len(cols))
    labels = [r["class"] for r in per]
    prior = np.log(np.array([r.n for r in per], float) / max(1, sum(r.n for r in per)))
    mu, var, n, up = (numbers([r[f] for r in per]) for f in ("mu", "var", "k", "up"))
    names = list(sets)
    table = np.zeros((len(cols), len(names)))
    for s, name in enumerate(names):
        table[[at[c] for c in sets[name]], s] = 1.0
    with np.errstate(invalid="ignore"):  # variances over all classes, from those within and the distances of the means
        total = n.sum(0)
        mean = np.nansum(n * mu, 0) / np.maximum(total, 1)
        top = np.nansum(n * (var + (mu - mean) ** 2), 0) / np.maximum(total, 1)
    eps = np.array([smoothing * max((top[at[c]] for c in sets[name]), default=0.0) for name in names])
    share = (up + alpha) / (n + 2 * alpha)

    def terms(v: np.ndarray, c: int, e: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            if kind == "gaussian":
                out = -0.5 * np.log(2 * np.pi * (var[c] + e)) - (v - mu[c]) ** 2 / (2 * (var[c] + e))
            else:
                out = np.where(np.isnan(v), np.nan, np.where(v > 0, np.log(share[c]), np.log(1 - share[c])))
        return np.nan_to_num(out)

    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for batch in it:
            if not batch.num_rows or not labels:
                continue
            v = batch.column("v").flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ll = np.zeros((len(labels), len(v), len(names)))
            for e in np.unique(eps) if kind == "gaussian" else (0.0,):
                mine = np.flatnonzero(eps == e) if kind == "gaussian" else np.arange(len(names))
                for c in range(len(labels)):
                    ll[c][:, mine] = terms(v, c, e) @ table[:, mine] + prior[c]
            best = np.argmax(np.round(ll, 9), axis=0)
            split, label = batch.column("split").to_pylist(), batch.column("label").to_pylist()
            group = {g: [i for i, z in enumerate(zip(split, label)) if z == g] for g in set(zip(split, label))}
            for (s, y), rows in group.items():
                for k, name in enumerate(names):
                    for c, m in enumerate(np.bincount(best[rows, k], minlength=len(labels)).tolist()):
                        if m:
                            total[name, s, y, labels[c]] = total.get((name, s, y, labels[c]), 0) + m
        keys = list(total)
        yield pa.RecordBatch.from_pydict({"set": pa.array([k[0] for k in keys], pa.string()), "split": pa.array([k[1] for k in keys], pa.string()), "label": pa.array([k[2] for k in keys], pa.int64()), "predicted": pa.array([k[3] for k in keys], pa.int64()), "n": pa.array([total[k] for k in keys], pa.int64())})

    rows = df.select("split", F.col(target).cast("long").alias("label"), F.array(*x).alias("v")).mapInArrow(predict, "set string, split string, label long, predicted long, n long")
    return rows.groupBy("set", "split", "label", "predicted").agg(F.sum("n").alias("n"))


def scores(df: DataFrame, key: str, cols: Sequence[str], target: str, sets: Sets, ks: Sequence[int] = KS) -> DataFrame:
    """``(set, model, split, measures)`` of both naive Bayes models and of nearest neighbours for every ``k``, for each set of variables.

    Equal sets are computed once. A set without variables has no rows.
    """
    same: dict[tuple[str, ...], list[str]] = {}
    for name, mine in sets.items():
        if mine:
            same.setdefault(tuple(sorted(mine, key=list(cols).index)), []).append(name)
    once = {f"s{i}": mine for i, mine in enumerate(same)}
    named = df.sparkSession.createDataFrame([(s, n) for s, names in zip(once, same.values()) for n in names], "s string, set string")
    bayes = None
    for model, kind in (("GaussianNB", "gaussian"), ("BernoulliNB", "bernoulli")):
        one = naive_bayes_sets(df, cols, target, once, kind).withColumn("model", F.lit(model))
        bayes = one if bayes is None else bayes.unionByName(one)
    at = {c: i for i, c in enumerate(cols)}
    near = M.knn(df, key, cols, target, list(ks), scope="all", slots=[(s, "euclidean", [at[c] for c in mine]) for s, mine in once.items()])
    near = near.groupBy(F.col("slot").alias("set"), "split", "label", "predicted", F.concat(F.lit("KNN k="), F.col("k").cast("string")).alias("model")).agg(F.count("*").alias("n"))
    counted = bayes.unionByName(near.withColumns({c: F.col(c).cast("long") for c in ("label", "predicted")})).withColumnRenamed("set", "s")
    m = M.class_metrics(counted, "label", "predicted", ["s", "model", "split"], "n")
    return m.join(F.broadcast(named), "s").select("set", "model", "split", *M.MEASURES)


def variance_sets(df: DataFrame, cols: Sequence[str], thresholds: Sequence[float]) -> dict[float, list[str]]:
    """For each threshold the variables whose variance over the ``train`` rows is not below it; an undefined variance stays."""
    low = {r.variable: r.variance for r in T.low_variance(df.where("split = 'train'"), cols, float("inf")).collect()}  # a row a column
    return {t: [c for c in cols if not low.get(c, float("inf")) < t] for t in thresholds}


def redundancy_sets(df: DataFrame, cols: Sequence[str], thresholds: Sequence[float]) -> dict[float, list[str]]:
    """For each threshold the variables that ``redundant`` doesn't name, by correlations over the ``train`` rows."""
    gone = {(r.threshold, r.variable) for r in T.redundant(T.correlations(df.where("split = 'train'"), cols), list(thresholds)).collect()}  # columns x thresholds at most
    return {t: [c for c in cols if (float(t), c) not in gone] for t in thresholds}


def study(df: DataFrame, key: str, cols: Sequence[str], target: str, sets: Mapping[float, Sequence[str]], ks: Sequence[int] = KS) -> DataFrame:
    """``(threshold, n_variables, model, split, measures)`` for the sets of either selector."""
    sizes = df.sparkSession.createDataFrame([(str(t), float(t), len(v)) for t, v in sets.items()], "set string, threshold double, n_variables int")
    return scores(df, key, cols, target, {str(t): v for t, v in sets.items()}, ks).join(F.broadcast(sizes), "set").select("threshold", "n_variables", "model", "split", *M.MEASURES)


def best_sets(scored: DataFrame, measure: str = "recall", least: float = 0.001) -> dict[str, tuple[float, str, float]]:
    """For ``NB`` and ``KNN`` the ``(threshold, model, value)`` that an ordered fold over thresholds and models keeps on the test rows."""
    rows = scored.where("split = 'test'").collect()  # thresholds x models
    rank = lambda r: (r.threshold, r.model != "GaussianNB", int(r.model.partition("=")[2] or 0))
    out = {}
    for family in ("NB", "KNN"):
        mine = sorted((r for r in rows if family in r.model), key=rank)
        at = M.best_of([r[measure] for r in mine], least)
        if at is not None:
            out[family] = (mine[at].threshold, mine[at].model, mine[at][measure])
    return out
