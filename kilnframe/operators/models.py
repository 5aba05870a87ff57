"""Baseline models and their evaluation as relational algebra; trained models through pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnframe.operators import neighbours as N
from kilnframe.operators.ranges import running

# -- evaluation ---------------------------------------------------------------


def class_metrics(df: DataFrame, label: str, predicted: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Accuracy, recall, precision, AUC of the hard labels, F1; positive is 1, undefined is 0; a row counts ``weight`` times."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = {k: F.sum(c.cast("long") * F.col(weight) if weight else c.cast("long")).alias(k) for k, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))}
    x = df.groupBy(*by).agg(*n.values()) if by else df.agg(*n.values())
    z = F.lit(0.0)
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), z)
    s = F.coalesce(F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")), z)
    q = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), z)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), z)
    return x.select(*by, "tp", "fp", "fn", "tn", ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), r.alias("recall"), q.alias("precision"), ((r + s) / 2).alias("auc"), f1.alias("f1"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """A row for each pair of labels, also those that don't occur."""
    n = df.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    v = n.select(F.explode(F.array("actual", "predicted")).alias("v")).distinct()
    grid = v.select(F.col("v").alias("actual")).crossJoin(v.select(F.col("v").alias("predicted")))
    return grid.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """False and true positive rates at each distinct score, the highest first; summed by ranges of scores."""
    g = df.groupBy(F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    c, total = running(g, "score", {"p": "tp", "n": "fp"}, falling=True)
    return c.select("score", F.try_divide(F.col("fp"), F.lit(total["n"])).alias("fpr"), F.try_divide(F.col("tp"), F.lit(total["p"])).alias("tpr"))


def forecast_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, MAPE (a share) and R2 (of a constant series: 1 if perfect, else 0)."""
    e = F.col(y) - F.col(yhat)
    base = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    x = base.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(2.220446049250313e-16))).alias("mape"), F.sum(e * e).alias("_e"), F.var_pop(y).alias("_v"), F.count("*").alias("_n")
    )
    t = F.col("_v") * F.col("_n")
    return x.select(*by, "rmse", "mae", "mape", F.when(t > 0, 1 - F.col("_e") / t).when(F.col("_e") == 0, 1.0).otherwise(0.0).alias("r2"))


def incumbent(df: DataFrame, order: str, value: str, least: float = 0.001, start: float = 0.0, block: int = 10_000) -> DataFrame:
    """The candidate kept by an ordered fold: a later one replaces it only if better by more than ``least``.

    Only a value above all before it can replace one, so those records are
    found first, by blocks of ``order`` (whole numbers) and the blocks' maxima;
    they are few, and the fold runs over them.
    """
    x = df.select(F.col(order).cast("long").alias("i"), F.col(value).cast("double").alias("v")).where("v is not null").withColumn("b", F.floor(F.col("i") / block))
    up = lambda *by: Window.partitionBy(*by) if by else Window.partitionBy()
    top = x.groupBy("b").agg(F.max("v").alias("m")).select("b", F.max("m").over(up().orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    seen = F.greatest(F.max("v").over(up("b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))
    records = x.join(F.broadcast(top), "b").withColumn("seen", seen).where(F.col("seen").isNull() | (F.col("v") > F.col("seen")))
    xs = F.array_sort(F.collect_list(F.struct("i", "v")))
    zero = F.struct(F.lit(None).cast("long").alias("i"), F.lit(start).cast("double").alias("v"))
    step = F.aggregate(xs, zero, lambda a, x: F.when(x["v"] - a["v"] > least, F.struct(x["i"].alias("i"), x["v"].alias("v"))).otherwise(a))
    return records.agg(step.alias("best")).select(F.col("best.i").alias("candidate"), F.col("best.v").alias("value"))


# -- classifiers --------------------------------------------------------------


def _long(df: DataFrame, key: str, cols: Sequence[str], target: str) -> DataFrame:
    return df.select(key, "split", F.col(target).alias("label"), F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])).alias("r")).select(key, "split", "label", "r.*")


def _by_class(x: DataFrame, fitted: DataFrame, priors: DataFrame, key: str, term: Column) -> DataFrame:
    """The class of the largest log likelihood for each row; ties go to the smaller label."""
    s = x.join(F.broadcast(fitted), "variable").groupBy(key, "split", "label", "class").agg(F.sum(term).alias("ll"))
    s = s.join(F.broadcast(priors), "class").withColumn("ll", F.col("ll") + F.col("prior"))
    return s.groupBy(key, "split", "label").agg(F.max_by("class", F.struct(F.round("ll", 9), -F.col("class"))).alias("predicted"))


def _priors(df: DataFrame, target: str) -> DataFrame:
    n = df.where("split = 'train'").groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("class", F.ln(F.col("n") / F.col("all")).alias("prior"), "n")


def gaussian_nb(df: DataFrame, key: str, cols: Sequence[str], target: str, smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes; variances get ``smoothing`` times the largest variance of a variable."""
    x = _long(df, key, cols, target)
    t = x.where("split = 'train'")
    top = t.groupBy("variable").agg(F.var_pop("x").alias("v")).agg((F.max("v") * smoothing).alias("eps"))
    f = t.groupBy("variable", F.col("label").alias("class")).agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var")).crossJoin(F.broadcast(top)).withColumn("var", F.col("var") + F.col("eps"))
    term = -0.5 * F.ln(2 * F.pi() * F.col("var")) - (F.col("x") - F.col("mu")) * (F.col("x") - F.col("mu")) / (2 * F.col("var"))
    return _by_class(x, f.drop("eps"), _priors(df, target).drop("n"), key, term)


def bernoulli_nb(df: DataFrame, key: str, cols: Sequence[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Bernoulli naive Bayes on ``x > 0`` with add-``alpha`` smoothing."""
    x = _long(df, key, cols, target).withColumn("x", (F.col("x") > 0).cast("double"))
    f = x.where("split = 'train'").groupBy("variable", F.col("label").alias("class")).agg(((F.sum("x") + alpha) / (F.count("x") + 2 * alpha)).alias("p"))
    term = F.when(F.col("x") > 0, F.ln("p")).otherwise(F.ln(1 - F.col("p")))
    return _by_class(x, f, _priors(df, target).drop("n"), key, term)


def knn(df: DataFrame, key: str, cols: Sequence[str], target: str, ks: Sequence[int], metric: str | Sequence[str] = "euclidean", scope: str = "test", slots: Sequence[N.Slot] | None = None) -> DataFrame:
    """``(slot, k, key, split, label, predicted)``: the votes of the nearest ``train`` rows for every ``k``.

    One search to the largest ``k`` serves all of them and all metrics; ``slots``
    names other ways to compare, on some of the variables. Predicted are the rows
    whose ``split`` is ``scope``, or with ``all`` every row, a training row then
    being its own neighbour. Votes tie to the smaller label, distances to the
    smaller key. Rows with a missing value, and training rows without a label,
    take no part.
    """
    ways = list(slots or [(m, m, range(len(cols))) for m in ([metric] if isinstance(metric, str) else metric)])
    asked = df if scope == "all" else df.where(F.col("split") == scope)
    near = N.nearest(asked, df.where(F.col(target).isNotNull() & (F.col("split") == "train")), key, cols, max(ks), target, ways)
    kind = dict(df.dtypes)[target]
    votes = near.select("slot", F.col("key").alias(key), F.array(*[F.struct(F.lit(k).alias("k"), N.vote(F.col("near"), k).cast(kind).alias("predicted")) for k in ks]).alias("r"))
    return votes.join(asked.select(key, "split", F.col(target).alias("label")), key).withColumn("r", F.explode("r")).select("slot", "r.k", key, "split", "label", "r.predicted")


def best_of(values: Sequence[float | None], least: float = 0.001, start: float = 0.0) -> int | None:
    """The place of the value kept by an ordered fold: a later one replaces it only if better by more than ``least``.

    The rule of ``incumbent`` for the measures of a grid, which are a short list.
    """
    at, top = None, start
    for i, v in enumerate(values):
        if v is not None and v - top > least:
            at, top = i, v
    return at


MEASURES = ("accuracy", "recall", "precision", "auc", "f1")
STUDY = "study string, candidate int, params string, split string, " + ", ".join(f"{m} double" for m in MEASURES) + ", winner boolean"


def studied(spark, grid: Sequence[tuple[str, dict[str, dict[str, float]]]], curve, measure: str = "recall", least: float = 0.001) -> DataFrame:
    """Rows of a search: the grid's measures on both splits with its winner marked, then its overfitting curve.

    ``grid`` has the candidates in order, each with the measures of each split;
    the winner is that of the test split. ``curve`` gets its place in the grid
    and returns such a list for the curve.
    """
    at = best_of([g.get("test", {}).get(measure) for _, g in grid], least)
    rows = [("grid", i, p, s, *[float(m[c]) for c in MEASURES], i == at) for i, (p, g) in enumerate(grid) for s, m in sorted(g.items())]
    if at is not None:
        rows += [("curve", i, p, s, *[float(m[c]) for c in MEASURES], p == grid[at][0]) for i, (p, g) in enumerate(curve(at)) for s, m in sorted(g.items())]
    return spark.createDataFrame(rows, STUDY)


def measured(predicted: DataFrame, by: Sequence[str]) -> dict[tuple, dict[str, dict[str, float]]]:
    """Measures by ``by`` and split of ``(label, predicted, split)``; a row for each candidate comes to the driver."""
    out: dict[tuple, dict[str, dict[str, float]]] = {}
    for r in class_metrics(predicted, "label", "predicted", [*by, "split"]).collect():
        out.setdefault(tuple(r[b] for b in by), {})[r.split] = {m: r[m] for m in MEASURES}
    return out


def knn_study(df: DataFrame, key: str, cols: Sequence[str], target: str, ks: Sequence[int] = range(1, 26, 2), metrics: Sequence[str] = N.METRICS, measure: str = "recall") -> DataFrame:
    """Every metric and ``k`` on both splits, the winner, and the curve of its metric over ``k``: one search for all."""
    got = measured(knn(df, key, cols, target, list(ks), metrics, "all"), ["slot", "k"])
    order = [(m, k) for m in metrics for k in ks]
    rows = [(f"metric={m}, k={k}", got.get((m, k), {})) for m, k in order]
    return studied(df.sparkSession, rows, lambda at: [r for r, o in zip(rows, order) if o[0] == order[at][0]], measure)


def perceptron_study(df: DataFrame, cols: Sequence[str], target: str, rates: Sequence[float], lag: int, rounds: int, hidden: Sequence[int] = (16,), measure: str = "recall") -> DataFrame:
    """A search over learning rates and numbers of iterations: a fit of ``lag`` iterations goes on from the weights before it.

    Gradient descent whose step falls with the root of the iteration, the one
    schedule that ``pyspark.ml`` has; it starts again with each lag. Rows with a
    gap take no part. The curve is that of the winner's rate.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(df).where(F.col(target).isNotNull()).select("features", F.col(target).cast("double").alias("label"), "split").persist()
    order, rows = [(r, n) for r in rates for n in range(1, rounds + 1)], []
    try:
        train = x.where("split = 'train'")
        for rate in rates:
            weights = None
            for n in range(1, rounds + 1):
                net = MultilayerPerceptronClassifier(layers=[len(cols), *hidden, 2], maxIter=lag, stepSize=rate, solver="gd", seed=42, tol=0.0)
                model = (net.setInitialWeights(weights) if weights is not None else net).fit(train)
                weights = model.weights
                got = measured(model.transform(x).withColumnRenamed("prediction", "predicted"), [])
                rows.append((f"stepSize={rate}, maxIter={n * lag}", got.get((), {})))
    finally:
        x.unpersist()
    return studied(df.sparkSession, rows, lambda i: [r for r, o in zip(rows, order) if o[0] == order[i][0]], measure)


def linear_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Ordinary least squares on one variable, fitted on ``train``; a prediction for each row."""
    t = df.where("split = 'train'").agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
    return df.crossJoin(F.broadcast(t)).withColumn("yhat", F.col("intercept") + F.col("slope") * F.col(x))


def multiple_regression(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    v = VectorAssembler(inputCols=list(xs), outputCol="features").transform(df)
    m = LinearRegression(featuresCol="features", labelCol=y, solver="normal", regParam=0.0, predictionCol="yhat").fit(v.where("split = 'train'"))
    return m.transform(v).drop("features")


# -- forecasters: rows (ts, y, split) ------------------------------------------


def simple_average(df: DataFrame) -> DataFrame:
    m = df.where("split = 'train'").agg(F.avg("y").alias("yhat"))
    return df.crossJoin(F.broadcast(m))


def persistence(df: DataFrame) -> DataFrame:
    """``optimist``: the value before, at the first place the last training value; ``realist``: that value throughout."""
    last = df.where("split = 'train'").agg(F.max_by("y", "ts").alias("realist"))
    w = Window.partitionBy("split").orderBy("ts")
    return df.crossJoin(F.broadcast(last)).withColumn("optimist", F.coalesce(F.lag("y", 1).over(w), F.col("realist")))


def rolling_mean_forecast(df: DataFrame, window: int) -> DataFrame:
    """A mean of the last ``window`` values that goes on over its own output, from the tail of train, for either split."""
    w = Window.partitionBy("split").orderBy("ts")
    rows = df.withColumn("_i", F.row_number().over(w))
    tail = df.where("split = 'train'").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda r: r["y"]), -window, window).alias("tail"))
    n = rows.agg(F.max("_i").alias("n"))
    steps = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.col("tail"), lambda a, i: F.array_append(a, F.aggregate(F.slice(a, -window, window), F.lit(0.0), lambda s, x: s + x) / window))
    path = tail.crossJoin(n).select(F.posexplode(F.slice(steps, window + 1, F.col("n"))).alias("p", "yhat")).select((F.col("p") + 1).alias("_i"), "yhat")
    return rows.join(F.broadcast(path), "_i").drop("_i")


WINDOWS = (3, 5, 7, 10, 15, 20, 25, 30, 40, 50)
ALPHAS = tuple(i / 10 for i in range(1, 10))


def forecast_search(df: DataFrame, candidates: Sequence[tuple[str, DataFrame]], measure: str = "r2", least: float = 0.001) -> DataFrame:
    """``(candidate, params, split, rmse, mae, mape, r2, winner)`` of forecasts with ``yhat``; the winner is that of the fold over the test rows, which starts below any value."""
    out = None
    for i, (name, f) in enumerate(candidates):
        one = f.select("split", "y", "yhat", F.lit(i).alias("candidate"), F.lit(name).alias("params"))
        out = one if out is None else out.unionByName(one)
    rows = forecast_metrics(out, "y", "yhat", ["candidate", "params", "split"]).collect()  # candidates x 2
    tests = sorted((r for r in rows if r.split == "test"), key=lambda r: r.candidate)
    at = best_of([r[measure] for r in tests], least, -100_000.0)
    best = None if at is None else tests[at].candidate
    kind = "candidate int, params string, split string, rmse double, mae double, mape double, r2 double, winner boolean"
    return df.sparkSession.createDataFrame([(r.candidate, r.params, r.split, r.rmse, r.mae, r.mape, r.r2, r.candidate == best) for r in sorted(rows, key=lambda r: (r.candidate, r.split))], kind)


def rolling_mean_study(df: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    return forecast_search(df, [(f"window={w}", rolling_mean_forecast(df, w)) for w in windows])


def smoothing_study(df: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    return forecast_search(df, [(f"alpha={a}", exponential_smoothing(df, a)) for a in alphas])


def exponential_smoothing(df: DataFrame, alpha: float) -> DataFrame:
    """A flat forecast of the last level; the level starts at the first value."""
    ys = F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda r: r["y"])
    level = F.aggregate(ys, F.lit(None).cast("double"), lambda a, y: F.coalesce(alpha * y + (1 - alpha) * a, y))
    return df.crossJoin(F.broadcast(df.where("split = 'train'").agg(level.alias("yhat"))))


def arima_css(y, p: int, d: int, q: int, steps: int):
    """Forecasts of an ARIMA(p, d, q) fitted by two-stage least squares on a long autoregression's residuals."""
    import numpy as np

    y = np.asarray(y, float)
    z = np.diff(y, d) if d else y.copy()
    mean = z.mean()
    z = z - mean
    n = len(z)
    long = min(max(p, q) + 4, n // 4)
    e = np.zeros(n)
    if q and long:
        x = np.column_stack([z[long - i - 1 : n - i - 1] for i in range(long)])
        b, *_ = np.linalg.lstsq(x, z[long:], rcond=None)
        e[long:] = z[long:] - x @ b
    start = max(p, q + (long if q else 0))
    cols = [z[start - i - 1 : n - i - 1] for i in range(p)] + [e[start - i - 1 : n - i - 1] for i in range(q)]
    w = np.linalg.lstsq(np.column_stack(cols), z[start:], rcond=None)[0] if cols else np.zeros(0)
    zs, es = list(z), list(e)
    for _ in range(steps):
        v = sum(w[i] * zs[-i - 1] for i in range(p)) + sum(w[p + i] * es[-i - 1] for i in range(q))
        zs.append(float(np.clip(v, -1e12, 1e12)))
        es.append(0.0)
    fc = np.array(zs[n:]) + mean
    for k in range(d - 1, -1, -1):  # undo the differences
        fc = np.diff(y, k)[-1] + np.cumsum(fc)
    return fc


def arima_study(df: DataFrame, key: str, orders: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Test RMSE and R2 of each order for each series of ``key``, a task for each pair."""
    import numpy as np
    import pandas as pd

    grid = df.sparkSession.createDataFrame([tuple(o) for o in orders], "p int, d int, q int")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values("ts")
        tr, te = g[g.split == "train"].y.to_numpy(), g[g.split == "test"].y.to_numpy()
        p, d, q = (int(g[c].iloc[0]) for c in ("p", "d", "q"))
        f = arima_css(tr, p, d, q, len(te))
        ss = ((te - te.mean()) ** 2).sum()
        return pd.DataFrame([{"series": str(g[key].iloc[0]), "p": p, "d": d, "q": q, "rmse": float(np.sqrt(((te - f) ** 2).mean())), "r2": float(1 - ((te - f) ** 2).sum() / ss) if ss else 0.0}])

    return df.crossJoin(F.broadcast(grid)).groupBy(key, "p", "d", "q").applyInPandas(one, "series string, p int, d int, q int, rmse double, r2 double")
