"""Neighbours, selection scores and tree prefixes against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnframe.operators import models as M
from kilnframe.operators import neighbours as N
from kilnframe.operators import prepare as P
from kilnframe.operators import selection as C
from kilnframe.operators import trees as X

COLS = [f"x{i}" for i in range(6)]


def table(n=140, seed=0, missing=False, text_keys=False):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 6)), 1)  # many ties
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=n) * 0.4 > 1).astype(int)
    f = pd.DataFrame(x, columns=COLS)
    if missing:
        f = f.mask(rng.random(f.shape) < 0.1)
    f["id"] = rng.permutation(n) * 3
    if text_keys:
        f["id"] = f["id"].map(lambda i: f"k{i:05d}")
    f["y"] = y
    f["split"] = np.where(rng.random(n) < 0.3, "test", "train")
    return f


def frame(spark, f):
    return spark.createDataFrame(f.astype(object).where(f.notna(), None).values.tolist(), ", ".join(f"{c} {'double' if c in COLS else 'int' if c == 'y' else 'string' if c == 'split' or f[c].dtype == object else 'long'}" for c in f.columns)).repartition(3)


DIST = {"manhattan": lambda d: np.abs(d).sum(1), "euclidean": lambda d: np.sqrt((d * d).sum(1)), "chebyshev": lambda d: np.abs(d).max(1)}


@pytest.mark.parametrize("text_keys", [False, True])
def test_nearest_in_blocks(spark, text_keys):
    f = table(missing=True, text_keys=text_keys)
    df = frame(spark, f)
    got = {(r.slot, r.key): [(x.d, x.other, x.val) for x in r.near] for r in N.nearest(df, df, "id", COLS, 7, "y", [(m, m, range(6)) for m in N.METRICS] + [("two", "euclidean", [1, 4])], apart=True, block=16).collect()}
    whole = f.dropna(subset=COLS)
    assert len(got) == 4 * len(whole)
    for slot, metric, cols in [*((m, m, COLS) for m in N.METRICS), ("two", "euclidean", ["x1", "x4"])]:
        for _, q in whole.iterrows():
            rest = whole[whole.id != q.id]
            d = np.round(DIST[metric](rest[cols].to_numpy(float) - q[cols].to_numpy(float)), 9)
            want = sorted(zip(d, rest.id, rest.y))[:7]
            assert [(a, b) for a, b, _ in got[slot, q.id]] == [(pytest.approx(a), b) for a, b, _ in want]
            assert [v for _, _, v in got[slot, q.id]] == [v for _, _, v in want]


def test_few_points_and_none(spark):
    f = table(12)
    df = frame(spark, f)
    assert all(len(r.near) == 3 for r in N.nearest(df, df.orderBy("id").limit(3), "id", COLS, 10, block=2).collect())
    assert N.nearest(df, df.limit(0), "id", COLS, 3).count() == 0 and N.nearest(df.limit(0), df, "id", COLS, 3).count() == 0
    plan = N.nearest(df, df, "id", COLS, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_votes_and_study(spark):
    f = table()
    df = frame(spark, f)
    tr = f[f.split == "train"]
    got = {(r.slot, r.k, r.id): r.predicted for r in M.knn(df, "id", COLS, "y", (1, 4, 9), N.METRICS, "all").collect()}
    assert len(got) == 9 * len(f)
    for m in N.METRICS:
        for _, q in f.iterrows():
            near = sorted(zip(np.round(DIST[m](tr[COLS].to_numpy(float) - q[COLS].to_numpy(float)), 9), tr.id, tr.y))
            for k in (1, 4, 9):
                votes = [v for _, _, v in near[:k]]
                assert got[m, k, q.id] == min(set(votes), key=lambda v: (-votes.count(v), v))
    rows = M.knn_study(df, "id", COLS, "y", (1, 3, 5)).collect()
    grid = [r for r in rows if r.study == "grid" and r.split == "test"]
    assert len(grid) == 9 and sum(r.winner for r in grid) == 1
    best = None
    for r in grid:
        if r.recall - (best.recall if best else 0.0) > 0.001:
            best = r
    assert best.winner and {r.params.split(",")[0] for r in rows if r.study == "curve"} == {best.params.split(",")[0]}
    assert M.best_of([None, 0.0005, 0.5, 0.5009, 0.502], 0.001) == 4 and M.best_of([0.0], 0.001) is None and M.best_of([-5.0], start=-math.inf) == 0


def test_fill_by_neighbours(spark):
    f = table(60, 3, missing=True)
    got = {r.id: r for r in P.knn_fill(frame(spark, f), "id", COLS, 4).collect()}
    x = f[COLS].to_numpy(float)
    for i, r in f.iterrows():
        for j, c in enumerate(COLS):
            if not math.isnan(x[i, j]):
                assert got[r.id][c] == x[i, j]
                continue
            near = []
            for o in range(len(f)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[o])
                if not math.isnan(x[o, j]) and both.any():
                    near.append((round(math.sqrt(((x[i] - x[o])[both] ** 2).sum() * 6 / both.sum()), 9), f.id[o], x[o, j]))
            assert got[r.id][c] == pytest.approx(np.mean([v for _, _, v in sorted(near)[:4]]))


def test_smote_balances(spark):
    f = table()
    df = frame(spark, f)
    low = int(f.y.value_counts().idxmin())
    new = P.smote(df, "id", COLS, "y", low, extra=None).toPandas()
    n = f.y.value_counts()
    assert len(new) == n.max() - n.min() and not new.duplicated(["id", "copy"]).any()
    each = new.groupby("id").size().reindex(f[f.y == low].id, fill_value=0)
    assert each.max() - each.min() <= 1
    mine = f[f.y == low][COLS].to_numpy(float)
    for _, r in new.iterrows():
        a = f[f.id == r.id][COLS].to_numpy(float)[0]
        p = r[COLS].to_numpy(float)
        d = mine - a
        t = ((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-12)
        assert (np.abs(a + t[:, None] * d - p).max(1) < 1e-9).any()
    assert P.smote(df.where(f"y <> {low} or id = {int(f[f.y == low].id.iloc[0])}"), "id", COLS, "y", low, extra=None).count() == 0


def test_scores_of_sets_as_one_by_one(spark):
    f = table(150, 5)
    df = frame(spark, f)
    sets = {"all": COLS, "two": ["x1", "x0"], "same": ["x0", "x1"], "one": ["x5"], "none": []}
    got = {(r["set"], r.model, r.split): r for r in C.scores(df, "id", COLS, "y", sets, (1, 5)).collect()}
    assert {s for s, _, _ in got} == set(sets) - {"none"}
    for name, mine in sets.items():
        if not mine:
            continue
        for model, pred in (("GaussianNB", M.gaussian_nb(df, "id", mine, "y")), ("BernoulliNB", M.bernoulli_nb(df, "id", mine, "y")), ("KNN k=5", M.knn(df, "id", mine, "y", (5,), scope="all"))):
            for r in M.class_metrics(pred, "label", "predicted", ["split"]).collect():
                assert [got[name, model, r.split][m] for m in M.MEASURES] == pytest.approx([r[m] for m in M.MEASURES]), (name, model)


def test_sets_by_thresholds(spark):
    f = table(150, 6)
    f["x4"], f["x5"] = f["x0"] + 0.01 * f["x1"], f["x0"] * 2
    df = frame(spark, f)
    tr = f[f.split == "train"]
    v = C.variance_sets(df, COLS, [0.5, 1.0, 2.0, 99.0])
    assert v == {t: [c for c in COLS if not tr[c].var() < t] for t in v} and v[99.0] == []
    r = C.redundancy_sets(df, COLS, [0.3, 0.9, 1.0])
    corr = tr[COLS].corr().abs()
    for t, kept in r.items():
        gone = {b for a in COLS if sum(corr.loc[a, b] >= t for b in COLS if b != a) >= 2 for b in COLS if b != a and corr.loc[a, b] >= t}
        assert kept == [c for c in COLS if c not in gone]


def test_best_sets(spark):
    rows = [(t, 3, m, "test", 0.0, v, 0.0, 0.0, 0.0) for t, m, v in ((0.1, "BernoulliNB", 0.5), (0.1, "GaussianNB", 0.4), (0.2, "GaussianNB", 0.5005), (0.2, "KNN k=10", 0.7), (0.2, "KNN k=5", 0.7), (0.3, "KNN k=1", 0.9))]
    df = spark.createDataFrame(rows, "threshold double, n_variables int, model string, split string, " + ", ".join(f"{m} double" for m in M.MEASURES))
    assert C.best_sets(df) == {"NB": (0.1, "BernoulliNB", 0.5), "KNN": (0.3, "KNN k=1", 0.9)}


def separate(spark, df, make):
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=COLS, outputCol="features").transform(df).withColumn("label", F.col("y").cast("double"))
    model = make.fit(v.where("split = 'train'"))
    return model, {r.id: int(r.prediction) for r in model.transform(v).select("id", "prediction").collect()}


def test_prefixes_are_the_smaller_models(spark):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier

    f = table(200, 7)
    df = frame(spark, f).coalesce(1).persist()
    x = f[COLS].to_numpy(float)
    for kind, sizes, make in (("tree", (1, 2, 3, 5, 8), lambda n: DecisionTreeClassifier(maxDepth=n, seed=42)), ("boosting", (1, 2, 5), lambda n: GBTClassifier(maxIter=n, maxDepth=3, seed=42))):
        (fit,) = X.fitted(df, COLS, "y", kind, [{} if kind == "tree" else {"maxDepth": 3}], max(sizes))
        for n, p in zip(sizes, X.predictions(fit, x, sizes)):
            assert dict(zip(f.id.tolist(), p.tolist())) == separate(spark, df, make(n))[1], (kind, n)
    (fit,) = X.fitted(df, COLS, "y", "forest", [{"maxDepth": 4}], 7)
    model, want = separate(spark, df, RandomForestClassifier(numTrees=7, maxDepth=4, seed=42))
    (p,) = X.predictions(fit, x, (7,))
    assert dict(zip(f.id.tolist(), p.tolist())) == want
    got = {r.variable: r for r in X.importances(spark, fit, COLS).collect()}
    assert [got[c].importance for c in COLS] == pytest.approx(model.featureImportances.toArray().tolist())
    assert any(r.deviation > 0 for r in got.values()) and sorted(r["rank"] for r in got.values()) == [1, 2, 3, 4, 5, 6]
    top = X.node_table(spark, fit, 2).collect()
    assert {r.depth for r in top} <= {0, 1, 2} and sum(r.depth == 0 for r in top) == 7


def test_tree_search(spark):
    df = frame(spark, table(200, 8))
    rows, fit = X.search(df, COLS, "y", "boosting", [{"maxDepth": 2, "stepSize": r} for r in (0.1, 0.5)], (1, 3))
    rows = rows.collect()
    assert len([r for r in rows if r.study == "grid"]) == 8 and len([r for r in rows if r.study == "curve"]) == 4
    assert fit is not None and {r.params for r in rows if r.winner and r.study == "grid"} <= {r.params for r in rows if r.study == "curve"}
    counted = X.counts(df, COLS, "y", [fit], (3,)).agg(F.sum("n")).first()[0]
    assert counted == 200


def test_rows_without_gaps_of_many_renamed_columns(spark):
    df = spark.range(20).select("id", *[F.when(F.col("id") != c, (F.col("id") + c).cast("double")).alias(f"v{c}") for c in range(8)], F.array(*[F.col("id") + F.lit(0.5) for _ in range(56)]).alias("a"))
    cols = [f"v{c}" for c in range(64)]
    df = df.select("id", *cols[:8], *[F.when(F.col("id") < 19, F.col("a")[c]).otherwise(float("nan")).alias(f"v{c + 8}") for c in range(56)])
    x = P.whole(df, cols)
    assert sorted(r.id for r in x.select("id").collect()) == list(range(8, 19))
    n = x.groupBy((F.col("id") % 2).alias("odd")).agg(*[F.avg(c) for c in cols]).count()
    assert n == 2 and x.count() == df.na.drop().count()


def test_a_search_without_a_winner_still_has_a_model(spark):
    f = table(200, 8)
    f["y"] = np.where(f.split == "test", f.y, 0)  # nothing to learn: recall 0 for every candidate
    rows, fit = X.search(frame(spark, f), COLS, "y", "forest", [{"maxDepth": 2}, {"maxDepth": 3}], (2, 3))
    assert not any(r.winner for r in rows.collect())
    assert len(fit.trees) == 2 and X.importances(spark, fit, COLS).count() == len(COLS)


def test_the_winner_has_its_own_size(spark):
    df = frame(spark, table(200, 7)).coalesce(1).persist()
    (full,) = X.fitted(df, COLS, "y", "tree", [{}], 8)
    (two,) = X.fitted(df, COLS, "y", "tree", [{}], 2)
    cut = X.sized(full, 2)
    assert cut.trees[0].depth.max() == 2 < full.trees[0].depth.max()
    key = lambda fit: [(r.variable, round(r.importance, 9)) for r in X.importances(spark, fit, COLS).collect()]
    assert key(cut) == key(two)


def test_keys_that_repeat_are_apart(spark):
    f = table(60, 11)
    f["id"] = f["id"] // 9  # three rows a key
    df = frame(spark, f)
    got = {(r.key): [x.other for x in r.near] for r in N.nearest(df, df.dropDuplicates(["id"]).union(df), "id", COLS, 5, "y", apart=True).collect()}
    assert all(k not in near and len(near) == 5 for k, near in got.items())


@pytest.mark.parametrize("scale,shift", [(1.0, 1e7), (1e25, 0.0), (1e-30, 0.0), (1.0, 0.0)])
def test_nearest_over_tiles_and_chunks(spark, monkeypatch, scale, shift):
    monkeypatch.setattr(N, "CHUNK", 50)
    monkeypatch.setattr(N, "TILE", 16)
    f = table(140, 12)
    f[COLS] = f[COLS] * scale + shift
    df = frame(spark, f)
    x = f[COLS].to_numpy(float)
    for r in N.nearest(df, df, "id", COLS, 6, "y", [(m, m, range(6)) for m in N.METRICS]).collect():
        q = x[f.id.tolist().index(r.key)]
        want = sorted(zip(np.round(DIST[r.slot](x - q), 9), f.id))[:6]
        assert [n.d for n in r.near] == pytest.approx([d for d, _ in want]) and (scale > 1 or [n.other for n in r.near] == [o for _, o in want])


def test_a_row_meets_each_query_once(spark, monkeypatch):
    """Lists of the best are one for each chunk of points, however many blocks there are."""
    df = frame(spark, table(140, 13))
    seen = []
    merged = N._merged
    monkeypatch.setattr(N, "_merged", lambda found, k: seen.append(found.count()) or merged(found, k))
    N.nearest(df, df, "id", COLS, 3, block=8)
    assert seen == [140]


@pytest.mark.parametrize("metric", ["manhattan", "chebyshev"])
@pytest.mark.parametrize("odd", [0.0, 1e6, 1e300, np.inf])
def test_whole_numbers_leave_out_no_near_pair(metric, odd):
    """Rough distances take two bytes, and what lies far from all else makes none of them too large."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 9)), rng.normal(size=(700, 9))
    b[::97, 3], a[::13, 5] = odd, -odd
    a[:, 7] = b[:, 7] = 2.0
    rough = N.Rough(b, metric, range(9))
    rough.queries(a)
    values, _ = rough.values(slice(0, 700))
    assert values.dtype == np.uint16
    with np.errstate(all="ignore"):
        x = np.abs(b[None] - a[:, None])
        d = np.round(x.sum(2) if metric == "manhattan" else x.max(2), 9)
    top = np.sort(d, 1)[:, 20]
    far = rough.far(values, None, top, np.arange(40), slice(0, 700))
    assert not (far & (d <= top[:, None])).any()
    assert odd or far.mean() > 0.8


def test_first_bounds_hold_with_copies_and_own_rows(monkeypatch):
    rng = np.random.default_rng(6)
    b = np.repeat(rng.normal(size=(60, 5)), 30, 0)[rng.permutation(1800)]
    a, own = b[:50].copy(), (np.arange(50), np.arange(1800))
    monkeypatch.setattr(N, "TILE", 256)
    for metric in N.METRICS:
        got = N._found(a, b, N.Rough(b, metric, range(5)), [(np.arange(50), None)], 40, own)[0]
        for q in range(50):
            x = np.abs(b - a[q])
            d = np.round({"manhattan": x.sum(1), "euclidean": np.sqrt((x * x).sum(1)), "chebyshev": x.max(1)}[metric], 9)
            want = [p for p in np.lexsort((np.arange(1800), d)) if p != q][:40]
            assert got.p[got.q == q].tolist() == want
