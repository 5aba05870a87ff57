"""The two flows as lists of steps: a classification table and a series, from raw rows to metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnframe.operators import models as M
from kilnframe.operators import prepare as P
from kilnframe.operators import selection as C
from kilnframe.operators import series as S
from kilnframe.sources.shared import kept


def techniques(df: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], measure: Callable[[DataFrame], DataFrame], original: bool = True) -> DataFrame:
    """Each technique's metrics: ``technique`` and the columns of ``measure``. A name leads to its own frame and no other.

    The rows, and what a technique makes of them, are written once: they are read several times.
    """
    out, df = None, kept(df, "study")
    for name, step in {**({"Original": lambda x: x} if original else {}), **steps}.items():
        m = measure(kept(step(df), "technique")).withColumn("technique", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def classified(df: DataFrame, key: str, cols: Sequence[str], target: str, k: int = 5) -> DataFrame:
    """Metrics of naive Bayes and of nearest neighbours, for rows with a ``split``."""
    counted = C.naive_bayes_sets(df, cols, target, {"all": list(cols)})
    nb = M.class_metrics(counted, "label", "predicted", ["split"], "n").withColumn("model", F.lit("NB"))
    kn = M.class_metrics(M.knn(df, key, cols, target, (k,)), "label", "predicted", ["split"]).withColumn("model", F.lit("KNN"))
    return nb.unionByName(kn)


def imputation_study(df: DataFrame, key: str, cols: Sequence[str], target: str) -> DataFrame:
    filled = lambda how: lambda x: P.fill(x, P.fit_fill(x, cols, [], how, "train"))
    ways = {"Remove": lambda x: P.whole(x, cols), "Mean": filled("mean"), "Median": filled("median")}
    return techniques(df, ways, lambda x: classified(x, key, cols, target), original=False)


def outlier_study(df: DataFrame, key: str, cols: Sequence[str], target: str, k: float = 5.0) -> DataFrame:
    b = P.fit_bounds(df, cols, k, "train")
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    steps = {n: (lambda x, f=f: f(train, b).unionByName(test.select(*[F.col(c).cast(t) for c, t in f(train, b).dtypes]))) for n, f in (("Drop", P.drop_outliers), ("Replace", P.replace_outliers), ("Truncate", P.truncate_outliers))}
    return techniques(df, steps, lambda x: classified(x, key, cols, target))


def scaling_study(df: DataFrame, key: str, cols: Sequence[str], target: str) -> DataFrame:
    return techniques(df, {"Standard": lambda x: P.scale(x, cols, "zscore", "train"), "MinMax": lambda x: P.scale(x, cols, "minmax", "train")}, lambda x: classified(x, key, cols, target))


def balancing_study(df: DataFrame, key: str, cols: Sequence[str], target: str) -> DataFrame:
    """Training rows balanced in three ways; the test rows stay."""
    train, test = df.where("split = 'train'"), df.where("split = 'test'").select(key, *cols, target, "split")
    way = lambda how: lambda _: P.balanced(train, key, cols, target, how).withColumn("split", F.lit("train")).unionByName(test)
    return techniques(df, {"Undersampling": way("undersampling"), "Oversampling": way("oversampling"), "SMOTE": way("smote")}, lambda x: classified(x, key, cols, target))


def forecast_study(series: DataFrame, window: int = 5, alpha: float = 0.3) -> DataFrame:
    """Metrics of every baseline forecaster on ``(ts, y, x)``, a row for each model and split."""
    s = P.split_temporal(series, "ts")
    p = M.persistence(s)
    models = {
        "Simple Average": M.simple_average(s),
        "Persistence Optimist": p.withColumn("yhat", F.col("optimist")),
        "Persistence Realist": p.withColumn("yhat", F.col("realist")),
        "Rolling Mean": M.rolling_mean_forecast(s, window),
        "Exponential Smoothing": M.exponential_smoothing(s, alpha),
        "Linear Regression": M.linear_regression(s, "x", "y"),
    }
    out = None
    for name, f in models.items():
        m = M.forecast_metrics(f, "y", "yhat", ["split"]).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def aggregation_study(series: DataFrame, levels: Sequence[str], how: str = "sum") -> DataFrame:
    out = None
    for v in levels:
        m = forecast_study(S.aggregate(series, v, {"y": how, "x": how})).withColumn("level", F.lit(v))
        out = m if out is None else out.unionByName(m)
    return out


def forecast_scaling_study(series: DataFrame) -> DataFrame:
    """Metrics of the linear regression on the series as it is, standardised and brought to [0, 1], parameters from ``train``."""
    s = P.split_temporal(series, "ts")
    steps = {"Standard": lambda x: P.scale(x, ["y", "x"], "zscore", "train"), "MinMax": lambda x: P.scale(x, ["y", "x"], "minmax", "train")}
    return techniques(s, steps, lambda x: M.forecast_metrics(M.linear_regression(x, "x", "y"), "y", "yhat", ["split"]))
