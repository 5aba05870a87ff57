"""Running sums by ranges, quantiles by group and fitted densities against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnframe.functions import encode as E
from kilnframe.operators import densities as Y
from kilnframe.operators import grouped as G
from kilnframe.operators import models as M
from kilnframe.operators import ranges as R
from kilnframe.operators import stats as T

INF = math.inf
KEYS = {
    "bigint": [None, *range(-70, 130)],
    "double": [None, -INF, *[i / 7 for i in range(-90, 90)], INF, math.nan],
    "string": [None, "", "Z", "a", "\u00e9", "\U0001f600", *[f"k{i:x}" for i in range(150)]],
    "date": [None, *[dt.date(1960, 1, 1) + dt.timedelta(i * 97) for i in range(160)]],
    "timestamp": [None, *[dt.datetime(2024, 10, 27, 0, 0) + dt.timedelta(minutes=13 * i) for i in range(160)]],
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("falling", [False, True])
@pytest.mark.parametrize("ranges", [7, 300])
def test_running_sums(spark, kind, falling, ranges):
    rows = [(k, i % 5 + 1) for i, k in enumerate(KEYS[kind])]
    df = spark.createDataFrame(rows, f"k {kind}, n bigint").repartition(3)
    got, total = R.running(df, "k", {"n": "upto"}, falling, ranges)
    want = df.orderBy(F.desc("k") if falling else F.asc("k")).collect()
    assert [r.k for r in got.orderBy("upto").collect()] == pytest.approx([r.k for r in want], nan_ok=True) if kind in ("bigint", "double") else [r.k for r in got.orderBy("upto").collect()] == [r.k for r in want]
    assert [r.upto for r in got.orderBy("upto").collect()] == list(np.cumsum([r.n for r in want]))
    assert total == {"n": sum(n for _, n in rows)}


def test_running_sums_of_nothing(spark):
    got, total = R.running(spark.createDataFrame([], "k string, n bigint"), "k", {"n": "upto"})
    assert got.collect() == [] and total == {"n": 0}


def test_curve_and_codes_need_no_single_task(spark):
    df = spark.range(5000).select((F.col("id") % 997).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    curve = M.roc(df, "y", "s")
    assert "SinglePartition" not in curve._jdf.queryExecution().toString()
    last = curve.orderBy("score").first()
    assert (last.fpr, last.tpr) == (1.0, 1.0)
    coded = E.codes(df, "s", "code")
    assert "SinglePartition" not in coded._jdf.queryExecution().toString()
    assert coded.where("s <> code").count() == 0
    assert M.roc(df.where("s < 0"), "y", "s").collect() == []


def test_dummies_of_too_many_values(spark):
    with pytest.raises(ValueError, match="more than 10"):
        E.one_hot(spark.range(11).select(F.col("id").cast("string").alias("v")), ["v"], most=10)


def group(k):
    """Values of group ``k``: of several sizes, some constant, infinite, missing, huge or close together."""
    rng = np.random.default_rng(k)
    kind = k % 8
    n = 1 + k % 37
    xs = {
        0: list(rng.normal(size=n * 9)),
        1: [7.5] * n,
        2: [None, math.nan, *rng.integers(0, 4, n).astype(float)],
        3: [INF, -INF, *rng.normal(size=n)],
        4: [1.7e308, -1.7e308] * n + [float(k)],
        5: [i * 5e-324 for i in range(n * 3)],
        6: list(np.exp(rng.normal(size=n * 6) * 9)),
        7: [None],
    }[kind]
    return [(None if k == 11 else f"g{k}", None if x is None else float(x)) for x in xs]


def plain(xs, p):
    h = (len(xs) - 1) * p
    a, b = xs[int(h)], xs[math.ceil(h)]
    if a == b or h == int(h):
        return a
    return a * (1 - h % 1) + b * (h % 1) if abs(b / 2 - a / 2) > 1e307 else a + (b - a) * (h % 1)


@pytest.mark.parametrize("small", [4, 10_000])
def test_quantiles_of_many_groups(spark, small):
    rows = [r for k in range(300) for r in group(k)]
    df = spark.createDataFrame(rows, "g string, x double").withColumn("one", F.lit(1)).repartition(5)
    ps = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r.q for r in G.quantiles(df, ["g"], ["x"], ps, small=small, buckets=8).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        xs = sorted(x for h, x in rows if h == g and x is not None and not math.isnan(x))
        if xs:
            want[g] = [plain(xs, p) for p in ps]
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=0, nan_ok=True), g


def test_description_by_group(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, None), ("a", 2.0, 5), (None, None, 1), ("b", None, None)]
    got = {(r.g, r.variable): r for r in T.describe(spark.createDataFrame(rows, "g string, x double, y int"), ["x", "y"], ["g"]).collect()}
    assert len(got) == 6
    r = got["a", "x"]
    assert (r["count"], r.nunique, r.min, r.p25, r.p50, r.p75, r.max) == (3, 2, 1.0, 1.5, 2.0, 2.0, 2.0)
    assert (got[None, "y"].p50, got[None, "x"]["count"], got[None, "x"].p50, got["b", "y"].nunique) == (1.0, 0, None, 0)
    assert T.describe(spark.createDataFrame([], "g string, x double"), ["x"], ["g"]).collect() == []


def test_types_by_extremes(spark):
    df = spark.createDataFrame([("a", 1.0, "1", None), ("b", 2.0, "2", None), ("a", 3.0, None, None)], "s string, x double, t string, n string")
    assert {r.variable: r.type for r in T.variable_types(df, ["s", "x", "t", "n"]).collect()} == {"s": "binary", "x": "numeric", "t": "binary", "n": "numeric"}


def likelihood(x, shift):
    v = np.log(x - shift)
    return -math.log(v.std()) - v.mean() - 0.5 - 0.5 * math.log(2 * math.pi)


def test_shifted_lognormal(spark):
    x = 40 + np.exp(np.random.default_rng(5).normal(1.0, 0.6, 4000))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,), (INF,)], "x double")
    fit = Y.lognormal(df, "x")
    assert fit["likelihood"] > likelihood(x, 0.0) + 0.05
    assert fit["likelihood"] == pytest.approx(likelihood(x, fit["shift"]))
    grid = max(likelihood(x, x.min() - (x.max() - x.min()) * 10.0**u) for u in np.linspace(-5, 3, 4000))
    assert fit["likelihood"] >= grid - 1e-6
    assert (fit["shift"], fit["log_mean"], fit["log_std"]) == pytest.approx((40, 1.0, 0.6), abs=0.12)
    bins = Y.densities(df, "x").orderBy("bin").collect()
    width = (x.max() - x.min()) / 20
    assert sum(b.n for b in bins) == 4000 and sum(b.density for b in bins) * width == pytest.approx(1)
    worst = lambda kind: max(abs(b[kind] - b.density) for b in bins)
    assert worst("lognormal") < worst("normal") and sum(b.lognormal for b in bins) * width == pytest.approx(1, abs=0.1)


def test_densities_without_a_fit(spark):
    assert Y.lognormal(spark.createDataFrame([(2.0,)] * 5, "x double"), "x") is None
    (b,) = Y.densities(spark.createDataFrame([(2.0,)] * 5, "x double"), "x").collect()
    assert (b.n, b.density, b.normal, b.exponential, b.lognormal) == (5, None, None, None, None)
    assert Y.densities(spark.createDataFrame([], "x double"), "x").where("n > 0").collect() == []


def test_rows_behind_quantiles_are_made_once(spark):
    """What leads to the columns, such as joins, runs once for all passes."""
    from kilnframe.operators import prepare as P

    made = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            made.add(len(pdf))
            yield pdf.assign(x=pdf.id * 1.5)[["x"]]

    df = spark.range(30_000).mapInPandas(count, "x double")
    ((low, top, mid),) = P.fit_bounds(df, ["x"], 2.0).values()
    assert mid == 29_999 * 0.75 and made.value == 30_000
