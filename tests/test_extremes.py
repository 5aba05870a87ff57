"""Quantiles and correlations of columns with infinite, huge, tiny and missing values."""

import math

import numpy as np
import pytest

from kilnframe.operators import stats as T

INF = math.inf


def plain(xs, p):
    """The interpolated quantile of sorted values, an infinite neighbour winning."""
    xs = sorted(x for x in xs if x is not None and not math.isnan(x))
    h = (len(xs) - 1) * p
    a, b = xs[int(h)], xs[math.ceil(h)]
    return a if a == b or h == int(h) else (a * (1 - (h % 1)) + b * (h % 1) if math.isinf(a) or math.isinf(b) or abs(b / 2 - a / 2) > 1e307 else a + (b - a) * (h % 1))


CASES = {
    "inf": [float(i) for i in range(190)] + [INF] * 10,
    "both ends": [float(i) for i in range(150)] + [INF] * 30 + [-INF] * 80,
    "only inf": [INF] * 100 + [-INF] * 101,
    "overflow": [1.7e308, -1.7e308] * 60 + [float(i) for i in range(81)],
    "subnormal": [i * 5e-324 for i in range(200)],
    "close": [1.0 + (i % 7) * 2.220446049250313e-16 for i in range(300)],
    "missing": [None, math.nan] * 50 + [float(i * i) for i in range(120)],
    "one": [3.0] * 250,
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("small", [10, 10_000])
def test_quantiles(spark, name, small):
    xs = CASES[name]
    df = spark.createDataFrame([(x, float(i)) for i, x in enumerate(xs)], "x double, y double")
    ps = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = T.exact_quantiles(df, ["x", "y"], ps, small=small, buckets=16)
    for g, p in zip(got["x"], ps):
        want = plain(xs, p)
        assert g == want or g == pytest.approx(want, rel=1e-12) or (math.isnan(g) and math.isnan(want)), (p, g, want)
    assert got["y"] == pytest.approx([np.quantile(np.arange(len(xs)), p) for p in ps])


def test_quantiles_of_nothing(spark):
    assert T.exact_quantiles(spark.createDataFrame([(None,), (math.nan,)], "x double"), ["x"], (0.5,)) == {"x": [None]}


def test_correlations_leave_out_what_is_not_finite(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=60)
    b = a + rng.normal(size=60)
    bad = [(math.nan, 1.0), (INF, 2.0), (3.0, None), (-INF, math.nan)]
    df = spark.createDataFrame([*zip(a.tolist(), b.tolist()), *bad], "a double, b double")
    (r,) = T.correlations(df, ["a", "b"]).collect()
    assert r["corr"] == pytest.approx(abs(np.corrcoef(a, b)[0, 1]))


def test_pair_counts(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 4)), 1)
    rows = [(*map(float, r), int(k) if k else None) for r, k in zip(x, rng.integers(0, 3, 90))]
    rows += [(math.nan, 1.0, 2.0, 3.0, 1), (None, INF, 0.5, 0.1, None)]
    rows = [(*r[:3], 7.0, r[4]) for r in rows]  # a constant column
    df = spark.createDataFrame(rows, "d double, c double, b double, a double, k int").repartition(3)
    names = ["a", "b", "c", "d"]
    col = {n: [r["dcba".index(n)] for r in rows] for n in names}
    ok = {n: [v is not None and math.isfinite(v) for v in col[n]] for n in names}
    lo, hi = ({n: f(v for v, o in zip(col[n], ok[n]) if o) for n in names} for f in (min, max))
    bin_ = lambda n, v: 0 if hi[n] == lo[n] else min(int((v - lo[n]) / (hi[n] - lo[n]) * 5), 4)
    want = {}
    for p, a in enumerate(names):
        for b in names[p + 1 :]:
            for i, r in enumerate(rows):
                if ok[a][i] and ok[b][i]:
                    key = (a, b, r[4], bin_(a, col[a][i]), bin_(b, col[b][i]))
                    want[key] = want.get(key, 0) + 1
    got = {(r.v1, r.v2, r.k, r.x_bin, r.y_bin): r.n for r in T.pair_counts(df, names, 5, "k").collect()}
    assert got == want
    assert T.pair_counts(df, names, 5).agg({"n": "sum"}).first()[0] == sum(want.values())
    assert T.pair_counts(df.limit(0), names).count() == 0
