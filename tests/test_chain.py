"""A chain of steps: what each stage goes on from, and what is read again."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from kilnframe.plans import chain as H
from test_search import COLS, frame, table


def start(spark):
    return H.Table(frame(spark, table(160, 9, missing=True)), "id", tuple(COLS), "y")


STAGES = H.classification_stages((0.5, 1.0), (0.5,), "f1")


def few(*names):
    return {n: STAGES[n] for n in names}


def test_stages_go_on_from_winners(spark, tmp_path):
    asked = []

    def scores(t):
        asked.append(t.rows.count())
        return H.classification_scores("f1")(t)

    end, steps = H.run(start(spark), few("missing", "scaling", "balancing"), scores, str(tmp_path))
    rows = steps.collect()
    assert len(asked) == 1 + 3 + 2 + 3  # 'Original' is scored once, then carried on
    by = {}
    for r in rows:
        by.setdefault(r.stage, []).append(r)
    for stage, mine in by.items():
        best = mine[0]
        for r in mine:
            if r.value - best.value > 0.001:
                best = r
        assert [r.winner for r in mine] == [r is best for r in mine], stage
    order = list(by)
    for a, b in zip(order, order[1:]):
        (won,) = [r for r in by[a] if r.winner]
        assert by[b][0].technique == "Original" and by[b][0].scores == won.scores
    again = start(spark)
    for step in H.chosen(steps):
        again = H.apply_step(again, step, STAGES)
    key = lambda t: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.rows.select("id", *t.cols, "y", "split").collect() if None not in r)
    assert key(again) == key(end)
    assert all(json.loads(r.parameters) is not None for r in rows)


def test_resumed_after_the_last_stage_is_gone(spark, tmp_path):
    count = []

    def scores(t):
        count.append(1)
        return {"one": float(len(count))}

    stages = few("missing", "outliers", "scaling")
    _, first = H.run(start(spark), stages, scores, str(tmp_path))
    want = sorted(map(str, first.where("place < 2").collect()))
    n = len(count)
    shutil.rmtree(tmp_path / "2_scaling" / "steps")  # rows without steps: the stage didn't end
    _, second = H.run(start(spark), stages, scores, str(tmp_path))
    assert len(count) == n + 2 and sorted(map(str, second.where("place < 2").collect())) == want
    assert [r.scores["one"] for r in second.where("place = 2").orderBy("value").collect()] == [float(n - 2), n + 1.0, n + 2.0]
    H.run(start(spark), stages, scores, str(tmp_path))
    assert len(count) == n + 2


def test_selection_driver(spark, tmp_path):
    t = start(spark)
    t = t._replace(rows=t.rows.na.drop().withColumn("x5", F.col("x0") * 0.001))
    end, steps = H.run(t, few("selection"), H.classification_scores("f1"), str(tmp_path))
    p = {r.technique: json.loads(r.parameters) for r in steps.collect()}
    assert "x5" in p["Variance"]["drop"] and p["Variance"]["threshold"] in (0.5, 1.0)
    (won,) = steps.where("winner").collect()
    assert set(end.cols) == set(COLS) - set(p[won.technique].get("drop", ())) and set(end.cols) <= set(end.rows.columns)


@pytest.mark.parametrize("how", ["undersampling", "oversampling", "smote"])
def test_balanced(spark, how):
    from kilnframe.operators import prepare as P

    f = table(150, 2)
    got = P.balanced(frame(spark, f), "id", COLS, "y", how).toPandas()
    n = got.y.value_counts()
    assert n.min() == n.max() == (f.y.value_counts().min() if how == "undersampling" else f.y.value_counts().max())
    assert got.id.is_unique and set(got.columns) == {"id", "y", *COLS}


def test_forecast_chain(spark, tmp_path):
    rows = [(f"2020-01-01 00:00:00", k, float(k % 7 + k / 10), float(k % 5)) for k in range(400)]
    s = spark.createDataFrame(rows, "t string, k int, y double, x double").select((F.col("t").cast("timestamp_ntz") + F.make_dt_interval(F.col("k"))).alias("ts"), "y", "x")
    from kilnframe.operators import prepare as P

    t = H.Table(P.split_temporal(s, "ts"), "ts", ("y", "x"), "y")
    end, steps = H.run(t, H.forecast_stages(("W", "M")), H.forecast_scores, str(tmp_path))
    assert steps.where("winner").count() == 4 and {"ts", "y", "x", "split"} <= set(end.rows.columns)
    short = t._replace(rows=t.rows.limit(3).withColumn("split", F.lit("train")))
    assert H.forecast_scores(short) == {}
