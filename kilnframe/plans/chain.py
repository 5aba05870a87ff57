"""Preparation as a chain of chosen steps: every technique of a stage is scored, the best one is applied, the next stage goes on from it.

A fitted step is a value: its stage, technique and parameters as JSON, which
``apply_step`` applies to any rows, in this session or a later one. A stage
writes its rows and then its steps; a chain that is run again reads what is there
and goes on with the first stage that is missing. The score of a stage's winner is
the score of 'Original' in the next one and isn't computed again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnframe.operators import models as M
from kilnframe.operators import prepare as P
from kilnframe.operators import selection as C
from kilnframe.operators import series as S
from kilnframe.sources.shared import kept

LEAST = 0.001
STEPS = "place int, stage string, technique string, parameters string, scores map<string,double>, value double, winner boolean"


class Step(NamedTuple):
    stage: str
    technique: str
    parameters: str


class Table(NamedTuple):
    """What a chain works on: rows with a ``split``, and which of their columns are what."""

    rows: DataFrame
    key: str
    cols: tuple[str, ...]
    target: str


#: Learns parameters that JSON can hold, and applies them.
Technique = tuple[Callable[[Table], dict], Callable[[Table, dict], Table]]


def _train(t: Table, change: Callable[[DataFrame], DataFrame]) -> Table:
    """Change the training rows only."""
    train, test = change(t.rows.where("split = 'train'")), t.rows.where("split = 'test'")
    return t._replace(rows=train.unionByName(test.select(*[F.col(c).cast(k).alias(c) for c, k in train.dtypes])))


def _balance(how: str) -> Technique:
    def apply(t: Table, p: dict) -> Table:
        return _train(t, lambda x: P.balanced(x, t.key, t.cols, t.target, how, p["seed"]).withColumn("split", F.lit("train")))

    return lambda t: {"seed": 42}, apply


def _fill(how: str) -> Technique:
    return lambda t: P.fit_fill(t.rows, t.cols, [], how, "train"), lambda t, p: t._replace(rows=P.fill(t.rows, p))


def _outliers(change: Callable, k: float = 5.0) -> Technique:
    return lambda t: P.fit_bounds(t.rows, t.cols, k, "train"), lambda t, p: _train(t, lambda x: change(x, p))


def _scale(how: str) -> Technique:
    return lambda t: P.fit_scale(t.rows, t.cols, how, "train"), lambda t, p: t._replace(rows=P.apply_scale(t.rows, p))


def _select(sets: Callable[[DataFrame, Sequence[str], Sequence[float]], Mapping[float, list[str]]], thresholds: Sequence[float], measure: str) -> Technique:
    """The selection driver: every threshold is scored, the best one of either model names the columns to drop."""

    def fit(t: Table) -> dict:
        kept = sets(t.rows, t.cols, thresholds)
        best = C.best_sets(C.study(t.rows, t.key, t.cols, t.target, kept), measure)
        if not best:
            return {"drop": []}
        at, model, value = max(best.values(), key=lambda b: (b[2], -b[0]))
        return {"threshold": at, "model": model, measure: value, "drop": [c for c in t.cols if c not in kept[at]]}

    def apply(t: Table, p: dict) -> Table:
        return t._replace(rows=t.rows.drop(*p["drop"]), cols=tuple(c for c in t.cols if c not in p["drop"]))

    return fit, apply


def classification_stages(variances: Sequence[float], correlations: Sequence[float], measure: str = "recall") -> dict[str, dict[str, Technique]]:
    """Missing values, outliers, scaling, balancing and selection, with the techniques of each."""
    return {
        "missing": {"Remove": (lambda t: {}, lambda t, p: t._replace(rows=P.whole(t.rows, t.cols))), "Mean": _fill("mean"), "Median": _fill("median")},
        "outliers": {"Drop": _outliers(P.drop_outliers), "Replace": _outliers(P.replace_outliers), "Truncate": _outliers(P.truncate_outliers)},
        "scaling": {"Standard": _scale("zscore"), "MinMax": _scale("minmax")},
        "balancing": {"Undersampling": _balance("undersampling"), "Oversampling": _balance("oversampling"), "SMOTE": _balance("smote")},
        "selection": {"Variance": _select(C.variance_sets, variances, measure), "Redundancy": _select(C.redundancy_sets, correlations, measure)},
    }


def classification_scores(measure: str = "recall", k: int = 5) -> Callable[[Table], dict[str, float]]:
    """The measure of naive Bayes and of nearest neighbours on the test rows."""

    def scores(t: Table) -> dict[str, float]:
        cols = list(t.cols)
        counted = C.naive_bayes_sets(t.rows, cols, t.target, {"all": cols}).select("split", "label", "predicted", "n", F.lit("NB").alias("model"))
        near = M.knn(t.rows, t.key, cols, t.target, (k,)).select("split", F.col("label").cast("long").alias("label"), F.col("predicted").cast("long").alias("predicted"), F.lit(1).cast("long").alias("n"), F.lit("KNN").alias("model"))
        m = M.class_metrics(counted.where("split = 'test'").unionByName(near), "label", "predicted", ["model"], "n")
        return {r.model: r[measure] for r in m.collect()}

    return scores


def _level(level: str) -> Technique:
    def apply(t: Table, p: dict) -> Table:
        x = S.aggregate(t.rows.select("ts", *t.cols), p["level"], dict.fromkeys(t.cols, "sum"))
        return t._replace(rows=P.split_temporal(x, "ts", 0.9))

    return lambda t: {"level": level}, apply


def _smooth(window: int) -> Technique:
    def apply(t: Table, p: dict) -> Table:
        w = p["window"]
        x = S.smooth(t.rows, "y", (w,)).withColumn("y", F.col(f"smooth_{w}")).drop(f"smooth_{w}")
        return t._replace(rows=x.where("y is not null"))

    return lambda t: {"window": window}, apply


def _difference(order: int) -> Technique:
    return lambda t: {"order": order}, lambda t, p: t._replace(rows=S.difference(t.rows, list(t.cols), p["order"]))


def forecast_stages(levels: Sequence[str] = ("W", "M", "Q"), windows: Sequence[int] = (5, 10, 25)) -> dict[str, dict[str, Technique]]:
    """Aggregation, scaling, smoothing of the training rows, and differences of a series ``(ts, y, x)``."""
    return {
        "aggregation": {v: _level(v) for v in levels},
        "scaling": {"Standard": _scale("zscore"), "MinMax": _scale("minmax")},
        "smoothing": {f"Window {w}": _smooth(w) for w in windows},
        "differences": {f"Order {k}": _difference(k) for k in (1, 2)},
    }


def forecast_scores(t: Table) -> dict[str, float]:
    """R2 on the test rows of the linear regression and of the last value carried on."""
    s = t.rows
    if s.where("split = 'test'").limit(2).count() < 2:  # too short to be scored
        return {}
    f = M.linear_regression(s, "x", "y").select("split", "y", "yhat", F.lit("Linear Regression").alias("model"))
    f = f.unionByName(M.persistence(s).select("split", "y", F.col("optimist").alias("yhat"), F.lit("Persistence").alias("model")))
    return {r.model: r.r2 for r in M.forecast_metrics(f, "y", "yhat", ["model", "split"]).where("split = 'test'").collect()}


def _value(scores: Mapping[str, float | None]) -> float:
    known = [v for v in scores.values() if v is not None]
    return sum(known) / len(known) if known else float("-inf")


def apply_step(t: Table, step: Step, stages: Mapping[str, Mapping[str, Technique]]) -> Table:
    """A fitted step on any rows; 'Original' changes nothing."""
    return t if step.technique == "Original" else stages[step.stage][step.technique][1](t, json.loads(step.parameters))


def run(t: Table, stages: Mapping[str, Mapping[str, Technique]], scores: Callable[[Table], dict[str, float]], path: str, least: float = LEAST) -> tuple[Table, DataFrame]:
    """The chain over all ``stages`` in order: what it leads to, and a row for each technique of each stage.

    A technique replaces the one before it only if its mean score is better by
    more than ``least``; ties stay with 'Original'. What ``path`` already holds of
    a chain is read, not computed; to choose anew, give another path. Rows that a
    technique makes are written once, as they are read for each model.
    """
    spark, before, tables = t.rows.sparkSession, None, []
    t = t._replace(rows=kept(t.rows, "start"))
    for place, (stage, ways) in enumerate(stages.items()):
        at = f"{path}/{place}_{stage}"
        try:
            steps = spark.read.schema(STEPS).parquet(f"{at}/steps").orderBy(F.col("winner").desc()).collect()
        except AnalysisException:
            steps = []
        if not steps:
            if before is None:
                before = scores(t)
            tried = [("Original", {}, before)]
            for name, (fit, apply) in ways.items():
                p = json.loads(json.dumps(fit(t)))
                made = apply(t, p)
                tried.append((name, p, scores(made._replace(rows=kept(made.rows, "tried")))))
            values = [_value(s) for _, _, s in tried]
            best = 0
            for i, v in enumerate(values):
                if v - values[best] > least:
                    best = i
            won = apply_step(t, Step(stage, tried[best][0], json.dumps(tried[best][1])), stages)
            won.rows.write.mode("overwrite").parquet(f"{at}/rows")
            rows = [(place, stage, n, json.dumps(p), {k: v for k, v in s.items() if v is not None}, v, i == best) for i, ((n, p, s), v) in enumerate(zip(tried, values))]
            spark.createDataFrame(rows, STEPS).coalesce(1).write.mode("overwrite").parquet(f"{at}/steps")
            steps = sorted(spark.read.schema(STEPS).parquet(f"{at}/steps").collect(), key=lambda r: not r.winner)
        left = spark.read.parquet(f"{at}/rows")
        t = t._replace(rows=left, cols=tuple(c for c in t.cols if c in left.columns))
        before = dict(steps[0].scores)
        tables.append(spark.read.schema(STEPS).parquet(f"{at}/steps"))
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return t, out


def chosen(steps: DataFrame) -> list[Step]:
    """The winners of a chain in order, to be applied elsewhere: one for each stage."""
    return [Step(r.stage, r.technique, r.parameters) for r in steps.where("winner").orderBy("place").collect()]
