"""Small literal fixtures with answers worked out by hand."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnframe.functions import encode as E
from kilnframe.operators import models as M
from kilnframe.operators import prepare as P
from kilnframe.operators import series as S
from kilnframe.operators import stats as T
from kilnframe.sources import tables as D


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def ts(spark):
    def make(ys, split=None):
        data = [(i, float(y), split[i] if split else "train") for i, y in enumerate(ys)]
        return spark.createDataFrame(data, "i int, y double, split string").select((F.to_timestamp(F.lit("2020-01-01")).cast("timestamp_ntz") + F.make_dt_interval(F.col("i"))).alias("ts"), "y", "split")

    return make


def test_describe_skips_nulls_and_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    r = T.describe(df, ["x"]).first()
    assert (r["count"], r.p50, r["mean"], r.p25) == (4, 2.5, 2.5, 1.75)
    assert math.isclose(r["std"], 1.2909944487358056)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 2.0), (3, 5.0, 3.0)], "k int, c double, x double")
    assert {r.c for r in P.scale(df, ["c"]).collect()} == {0.0}
    assert {r.c for r in P.scale(df, ["c"], "minmax").collect()} == {0.0}
    assert T.correlations(df, ["c", "x"]).first()["corr"] is None
    assert T.low_variance(df, ["c", "x"], 0.5).first().variable == "c"


def test_mode_ties_go_to_the_smaller(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    assert P.fit_fill(df, [], ["v"]) == {"v": "a"}


def test_variable_types(spark):
    df = spark.createDataFrame([(0, "1.5", "2020-01-01", "x"), (1, "2", "2020-02-01", "y"), (0, None, None, "z")], "b int, n string, d string, s string")
    df = df.unionByName(spark.createDataFrame([(1, "3", "2020-03-01", "w")], df.schema))
    assert {r.variable: r.type for r in T.variable_types(df, df.columns).collect()} == {"b": "binary", "n": "numeric", "d": "date", "s": "symbolic"}


def test_redundant_drops_all_partners_of_a_trio(spark):
    c = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.9), ("d", "e", 0.9), ("a", "d", 0.1)], "v1 string, v2 string, corr double")
    assert sorted(r.variable for r in T.redundant(c, 0.8).collect()) == ["a", "b", "c"]


def test_outliers_keep_nulls(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 100]] + [(None,)], "x double")
    b = {"x": (0.0, 10.0, 1.0)}
    assert P.drop_outliers(df, b).count() == 5
    assert sorted(r.x for r in P.replace_outliers(df, b).collect() if r.x is not None) == [1.0] * 5
    got = P.truncate_outliers(df, b).collect()
    assert max(r.x for r in got if r.x is not None) == 10.0 and sum(r.x is None for r in got) == 1


def test_rolling_and_differences(ts):
    got = S.smooth(ts([1, 2, 3, 4, 5]), "y", [3]).orderBy("ts").collect()
    assert [r.smooth_3 for r in got] == [None, None, 2.0, 3.0, 4.0]
    line = ts([2 * t + 1 for t in range(1, 7)])
    assert [r.y for r in S.difference(line, ["y"]).collect()] == [2.0] * 5
    assert [r.y for r in S.difference(line, ["y"], 2).collect()] == [0.0] * 4


def test_decomposition_adds_up(ts):
    got = S.decompose(ts([(t % 4) * 3 + t for t in range(24)]), "y", 4).where("trend is not null").collect()
    assert got and all(math.isclose(r.trend + r.seasonal + r.residual, r.observed, abs_tol=1e-9) for r in got)
    assert max(abs(r.residual) for r in got) < 1e-9


def test_rolling_forecast_runs_on_its_own_output(ts):
    df = ts([1, 2, 3, 9, 9, 9, 9], ["train"] * 3 + ["test"] * 4)
    got = [r.yhat for r in M.rolling_mean_forecast(df, 3).where("split = 'test'").orderBy("ts").collect()]
    assert [round(x, 6) for x in got] == [2.0, 2.333333, 2.444444, 2.259259]


def test_smoothing_and_persistence(ts):
    df = ts([1, 2, 4, 7, 8], ["train"] * 3 + ["test"] * 2)
    assert {r.yhat for r in M.exponential_smoothing(df, 0.5).collect()} == {2.75}
    p = M.persistence(df).orderBy("ts").collect()
    assert [r.optimist for r in p] == [4.0, 1.0, 2.0, 4.0, 7.0] and {r.realist for r in p} == {4.0}


def test_incumbent_is_a_fold(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5005), (3, 0.51)], "i int, v double")
    assert M.incumbent(df, "i", "v").first().candidate == 3
    assert M.incumbent(df.where("v > 9"), "i", "v").first().candidate is None


def test_class_metrics(spark):
    data = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    r = M.class_metrics(spark.createDataFrame(data, "y int, p int"), "y", "p").first()
    assert (r.accuracy, r.recall, r.precision, round(r.f1, 6), round(r.auc, 6)) == (0.7, 0.6, 0.75, 0.666667, 0.7)
    none = M.class_metrics(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p").first()
    assert (none.recall, none.precision, none.f1) == (0.0, 0.0, 0.0)


def test_coordinates(spark):
    r = T.dms(spark.createDataFrame([(-73.9,), (None,)], "x double"), "x", "E", "W").orderBy(F.col("x").asc_nulls_last()).first()
    assert (r.x_hemisphere, r.x_degrees, r.x_minutes, r.x_seconds) == ("W", -73, 54, 0.0)


def test_one_hot_and_codes(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "two string, three string")
    assert E.one_hot(df, ["two", "three"]).columns == ["two_b", "three_x", "three_y", "three_z"]
    assert sorted((r.two or "", r.c) for r in E.codes(df, "two", "c").collect() if r.two) == [("a", 0), ("b", 1)]


def test_splits_and_samples(spark):
    df = spark.range(101)
    s = P.split_random(df, "id")
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"test": 31, "train": 70}
    assert P.sample(df, "id", 10).count() == 10
    t = df.withColumn("y", (F.col("id") < 20).cast("int"))
    assert P.class_sizes(P.undersample(t, "id", "y"), "y") == {0: 20, 1: 20}
    assert P.class_sizes(P.oversample(t, "id", "y"), "y") == {0: 81, 1: 81}


def test_smote_stays_between_parents(spark):
    df = spark.createDataFrame([(i, float(i), 1) for i in range(6)] + [(99, 50.0, 0)], "k int, x double, y int")
    got = P.smote(df, "k", ["x"], "y", 1, k=2).collect()
    assert len(got) == 6 and all(0.0 <= r.x <= 5.0 for r in got)


def test_sources(spark, tmp_path):
    p = tmp_path / "t.v1.csv"
    p.write_text("Date;v\n01/31/2020;1.5\n13/45/2020;NaN\n")
    df = D.read_csv(spark, str(p), "v", "Date string, v double", ";", "Date", "MM/dd/yyyy")
    got = df.orderBy(F.col("Date").asc_nulls_last()).collect()
    assert got[0].Date.month == 1 and got[1].Date is None and got[1].v is None
    assert D.file_tag(str(p)) == "t"
    with pytest.raises(D.MissingTarget):
        D.read_csv(spark, str(p), "nothing", sep=";")


def test_unit_root(ts):
    import numpy as np

    rng = np.random.default_rng(0)
    noise = rng.standard_normal(400)
    assert S.adf(noise)["stationary"] and not S.adf(np.cumsum(noise))["stationary"]


def test_arima_follows_an_autoregression():
    import numpy as np

    rng = np.random.default_rng(1)
    y = [0.0]
    for e in rng.standard_normal(500):
        y.append(0.9 * y[-1] + e)
    f = M.arima_css(np.array(y), 1, 0, 0, 3)
    assert abs(f[0] - 0.9 * y[-1]) < 0.5


def test_stream_matches_batch(spark, tmp_path):
    from kilnframe.streaming.periods import windowed

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = windowed(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("by_day").start()
    try:
        q.processAllAvailable()
        assert spark.table("by_day").exceptAll(windowed(src)).count() == 0
    finally:
        q.stop()


def test_exact_quantiles_of_uneven_values(spark):
    rng = random.Random(1)
    xs = [rng.choice([0.0, 0.0, 1.5, rng.lognormvariate(0, 6), -rng.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(x, 7.0, None if i % 2 else x) for i, x in enumerate(xs)] + [(None, None, None)], "a double, b double, c double")
    got = T.exact_quantiles(df, ["a", "b", "c"], (0.0, 0.25, 0.5, 0.99, 1.0), small=20, buckets=8)
    for c, v in (("a", xs), ("b", [7.0]), ("c", xs[::2])):
        assert np.allclose(got[c], np.quantile(v, (0.0, 0.25, 0.5, 0.99, 1.0)), rtol=1e-12)
    assert T.exact_quantiles(df.limit(0), ["a"], (0.5,)) == {"a": [None]}


def test_correlations_are_the_same_for_any_number_of_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 14)) + 1e6
    x[:, 3] += 5 * x[:, 2]
    frame = pd.DataFrame(x, columns=[f"c{k:02d}" for k in range(14)])
    frame.iloc[:100, 0] = np.nan
    frame.iloc[100:, 1] = np.nan
    frame["c05"] = 4.0
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    want = frame.corr().abs()
    for cols in (list(frame.columns)[:6], list(frame.columns)):
        got = {(r.v1, r.v2): r["corr"] for r in T.correlations(df, cols).collect()}
        assert len(got) == len(cols) * (len(cols) - 1) // 2
        for (a, b), c in got.items():
            assert c is None if np.isnan(want.loc[a, b]) else abs(c - want.loc[a, b]) < 1e-7, (a, b)


def test_ranks_and_incumbent(spark):
    df = spark.range(500).withColumn("v", (F.col("id") * 37 % 101).cast("double") / 100)
    assert sorted(r["rank"] for r in P.ranks(df, "id").collect()) == list(range(500))
    drawn = P.sample_with_replacement(df, "id", 2000)
    assert drawn.count() == 2000 and drawn.select("id").distinct().count() > 450
    best, kept = 0.0, None
    for r in df.orderBy("id").collect():
        if r.v - best > 0.05:
            best, kept = r.v, r.id
    for block in (7, 10_000):
        assert tuple(M.incumbent(df, "id", "v", 0.05, block=block).first()) == (kept, best)
