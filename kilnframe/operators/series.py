"""Time series: periods, lags, rolling means, differences, components.

A window without partitions is used only on a series, whose length is bounded
by the number of periods; rows of a fact table are aggregated to periods first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The names of calendar periods.
PERIODS = {"H": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
YEARS = {"two_years": 2, "five_years": 5}


def period(ts: Column | str, level: str) -> Column:
    """The start of the period, without a zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if level in YEARS:
        k = YEARS[level]
        return F.make_timestamp_ntz((F.floor(F.year(c) / k) * k).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.date_trunc(PERIODS[level], c).cast("timestamp_ntz")


def aggregate(df: DataFrame, level: str, how: Mapping[str, str], ts: str = "ts") -> DataFrame:
    """Sum (of nothing: 0) or mean for each period that occurs."""
    f = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg}
    return df.groupBy(period(ts, level).alias(ts)).agg(*[f[h](c).alias(c) for c, h in how.items()])


def by_levels(df: DataFrame, levels: Sequence[str], how: Mapping[str, str], ts: str = "ts") -> DataFrame:
    """``aggregate`` for several levels at once, from one scan and one shuffle."""
    f = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg}
    at = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), period(ts, v).alias("start")) for v in levels]))
    x = df.select(at.alias("_at"), *how).groupBy("_at").agg(*[f[h](c).alias(c) for c, h in how.items()])
    return x.select(F.col("_at.start").alias(ts), *how, F.col("_at.level").alias("level"))


def over(ts: str = "ts", by: Sequence[str] = ()) -> Window:
    return (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(ts)


def lags(df: DataFrame, col: str, ks: Sequence[int], ts: str = "ts") -> DataFrame:
    return df.withColumns({f"lag_{k}": F.lag(col, k).over(over(ts)) for k in ks})


def lag_series(max_lag: int, delta: int) -> list[int]:
    """Lag 1 and the multiples of ``delta`` up to ``max_lag``."""
    return [1, *[k for k in range(delta, max_lag + 1, delta) if k != 1]]


def autocorrelation(df: DataFrame, col: str, most: int = 10, ts: str = "ts", centred: bool = False) -> DataFrame:
    """Lags ``-most`` to ``most``: products at a lag over the sum of squares."""
    x = df.withColumn("_x", F.col(col) - F.avg(col).over(Window.partitionBy()) if centred else F.col(col))
    x = x.select("_x", *[F.lag("_x", k).over(over(ts)).alias(f"_l{k}") for k in range(most + 1)])
    row = x.agg(*[(F.sum(F.col("_x") * F.col(f"_l{k}")) / F.sum(F.col("_x") * F.col("_x"))).alias(str(k)) for k in range(most + 1)])
    items = [F.struct(F.lit(k).alias("lag"), F.col(f"`{abs(k)}`").alias("value")) for k in range(-most, most + 1)]
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def rolling_mean(col: str, w: int, ts: str = "ts", by: Sequence[str] = ()) -> Column:
    """Null until the window is full."""
    frame = over(ts, by).rowsBetween(-(w - 1), 0)
    return F.when(F.count(col).over(frame) == w, F.avg(col).over(frame))


def smooth(df: DataFrame, col: str, sizes: Sequence[int], ts: str = "ts") -> DataFrame:
    """All window sizes in one pass; for rows with a ``split`` only those of ``train`` are smoothed."""
    by = ["split"] if "split" in df.columns else []
    return df.withColumns({f"smooth_{w}": F.when(F.lit(not by) | (F.col("split") == "train") if by else F.lit(True), rolling_mean(col, w, ts, by)).otherwise(F.col(col)) for w in sizes})


def difference(df: DataFrame, cols: Sequence[str], order: int = 1, ts: str = "ts") -> DataFrame:
    """Differences of first or second order, of train and test apart; rows without one go."""
    by = ["split"] if "split" in df.columns else []
    w = over(ts, by)
    one = {c: F.col(c) - F.lag(c, 1).over(w) for c in cols}
    two = {c: F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w) for c in cols}
    return df.withColumns(one if order == 1 else two).na.drop(subset=list(cols))


def sequences(df: DataFrame, col: str, length: int, ts: str = "ts") -> DataFrame:
    """Runs of ``length`` values and the value after each."""
    frame = over(ts).rowsBetween(0, length - 1)
    x = df.select(ts, F.collect_list(col).over(frame).alias("window"), F.lead(col, length).over(over(ts)).alias("next"))
    return x.where((F.size("window") == length) & F.col("next").isNotNull())


def decompose(df: DataFrame, col: str, m: int, ts: str = "ts") -> DataFrame:
    """Additive trend (centred moving average), seasonal (mean of the detrended by place, centred) and residual."""
    h = m // 2
    w = over(ts)
    x = df.select(ts, F.col(col).alias("observed"), F.row_number().over(w).alias("_i"))
    inner = w.rowsBetween(-h, h) if m % 2 else w.rowsBetween(-(h - 1), h - 1)
    s, n = F.sum("observed").over(inner), F.count("observed").over(inner)
    a, b = F.lag("observed", h).over(w), F.lead("observed", h).over(w)
    trend = F.when(n == m, s / m) if m % 2 else F.when(a.isNotNull() & b.isNotNull(), (s + 0.5 * a + 0.5 * b) / m)
    x = x.withColumn("trend", trend).withColumn("_p", (F.col("_i") - 1) % m)
    p = x.groupBy("_p").agg(F.avg(F.col("observed") - F.col("trend")).alias("_s"))
    c = p.agg(F.avg("_s").alias("_c"))
    y = x.join(F.broadcast(p), "_p").crossJoin(F.broadcast(c)).withColumn("seasonal", F.col("_s") - F.col("_c"))
    return y.select(ts, "observed", "trend", "seasonal", (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("residual"))


def stationarity(df: DataFrame, col: str, bins: int = 10, ts: str = "ts") -> DataFrame:
    """The mean, the band of a population deviation and the line of segment means (row ``j`` gets segment ``min(j // (n // bins), bins - 1)``)."""
    g = Window.partitionBy()
    x = df.select(ts, F.col(col).alias("y"), (F.row_number().over(over(ts)) - 1).alias("_j"), F.count("*").over(g).alias("_n"), F.avg(col).over(g).alias("mean"), F.round(F.stddev_pop(col).over(g), 3).alias("std"))
    k = F.floor((F.col("_j") * bins + bins - 1) / F.col("_n")).cast("int")
    # segment k holds the rows [k * n // bins, (k + 1) * n // bins)
    seg = x.withColumn("_k", F.least(k, F.lit(bins - 1)))
    seg = seg.withColumn("_k", F.when(F.col("_j") < F.floor(F.col("_k") * F.col("_n") / bins), F.col("_k") - 1).when(F.col("_j") >= F.floor((F.col("_k") + 1) * F.col("_n") / bins), F.col("_k") + 1).otherwise(F.col("_k")))
    means = seg.groupBy("_k").agg(F.avg("y").alias("segment_mean"))
    at = F.least(F.floor(F.col("_j") / F.greatest(F.floor(F.col("_n") / bins), F.lit(1))), F.lit(bins - 1)).cast("int")
    return x.withColumn("_k", at).join(F.broadcast(means), "_k", "left").select(ts, "y", "mean", "std", "segment_mean")


def adf(y, max_lag: int | None = None) -> dict[str, float]:
    """Augmented Dickey-Fuller statistic of a series in memory, with a constant; the lag of the least AIC."""
    import numpy as np

    y = np.asarray(y, float)
    n = len(y)
    most = max_lag if max_lag is not None else int(np.ceil(12 * (n / 100) ** 0.25))
    most = max(0, min(most, n // 2 - 3))
    d = np.diff(y)
    best = None
    for p in range(most + 1):
        rows = len(d) - most
        x = np.column_stack([y[most:-1], np.ones(rows), *[d[most - i : len(d) - i] for i in range(1, p + 1)]])
        t = d[most:]
        b, *_ = np.linalg.lstsq(x, t, rcond=None)
        r = t - x @ b
        aic = rows * np.log(max(r @ r / rows, 1e-300)) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            s2 = r @ r / max(rows - x.shape[1], 1)
            best = (aic, p, b[0] / np.sqrt(s2 * np.linalg.pinv(x.T @ x)[0, 0]))
    #: Large-sample critical values of the test with a constant.
    critical = {"1%": -3.43, "5%": -2.86, "10%": -2.57}
    return {"statistic": float(best[2]), "lag": int(best[1]), "critical_1": critical["1%"], "critical_5": critical["5%"], "critical_10": critical["10%"], "stationary": bool(best[2] <= critical["5%"])}


def adf_by(df: DataFrame, key: str, col: str, ts: str = "ts") -> DataFrame:
    """The test for each series of ``key``; a series is one group."""
    import pandas as pd

    def one(k, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"series": str(k[0]), **adf(pdf.sort_values(ts)[col].to_numpy())}])

    return df.groupBy(key).applyInPandas(one, "series string, statistic double, lag int, critical_1 double, critical_5 double, critical_10 double, stationary boolean")
