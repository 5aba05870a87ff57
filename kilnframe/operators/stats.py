"""Profiling: every operator is one aggregation, or one fit and one aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NUMERIC = ("bigint", "int", "smallint", "tinyint", "double", "float")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC]


def long_form(row: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row of columns ``<col>__<field>`` to one row for each column."""
    items = [F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in cols]
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


SMALL = 10_000


@contextmanager
def held(df: DataFrame, cols: Sequence[str]) -> Iterator[DataFrame]:
    """The columns of ``df``, stored while they are read several times: what leads to them, such as joins, runs once."""
    x = df.select(*dict.fromkeys(cols)).persist()
    try:
        yield x
    finally:
        x.unpersist()


def exact_quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], small: int = SMALL, buckets: int = 512) -> dict[str, list[float | None]]:
    """``held_quantiles`` of columns that are stored for its passes."""
    with held(df, cols) as x:
        return held_quantiles(x, cols, ps, small, buckets)


def held_quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], small: int = SMALL, buckets: int = 512) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column, exact, without sorting it or holding its distinct values.

    Values are counted by equal buckets of their range; the bucket that holds a
    wanted rank is counted by buckets in turn, all columns and ranks in one pass,
    until it holds ``small`` rows, one value, or values too close to be told
    apart by halves of their difference; those few values are ranked here. The
    driver gets counts of buckets. Missing values and NaN don't count; infinite
    values are ranks at the two ends, and between two values of which one is
    infinite the quantile is that infinite one (NaN between both).
    """
    inf = float("inf")
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    finite = {c: F.when(F.abs(x[c]) != inf, x[c]) for c in cols}
    row = df.agg(*[f.alias(f"{i}{n}") for i, c in enumerate(cols) for n, f in (("n", F.count(x[c])), ("low", F.count_if(x[c] == -inf)), ("m", F.count(finite[c])), ("lo", F.min(finite[c])), ("hi", F.max(finite[c])))]).first()
    got: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int, int]] = {}
    for i, c in enumerate(cols):
        n, low, m = row[f"{i}n"], row[f"{i}low"], row[f"{i}m"]
        for p in ps:
            for r in {int((n - 1) * p), -int(-(n - 1) * p // 1)} if n else ():
                if low <= r < low + m:
                    open_[c, r] = (row[f"{i}lo"], row[f"{i}hi"], low, m)
                else:
                    got[c, r] = -inf if r < low else inf

    def settle(now: list[tuple[str, float, float, int, int]], counts: dict[int, list], found) -> None:
        """Find each wanted rank in the sorted counts of its range."""
        place = {(c, lo, hi, before, n): i for i, (c, lo, hi, before, n) in enumerate(now)}
        for (c, r), v in list(open_.items()):
            at = v[2]
            for b in counts.get(place.get((c, *v), -1), ()):
                if at + b.n > r:
                    found((c, r), b, at, v)
                    break
                at += b.n

    def narrow(k, b, at, old) -> None:
        if b.lo == b.hi:
            got[k] = b.lo
            del open_[k]
        else:
            open_[k] = (b.lo, b.hi, at, b.n)
            if (b.lo, b.hi) == old[:2]:
                close.add((k[0], *open_[k]))

    def take(k, v, at, old) -> None:
        got[k] = v.x
        del open_[k]

    def counted(now: list[tuple[str, float, float, int, int]], what, *keys: str) -> dict[int, list]:
        at = [F.when((finite[c] >= lo) & (finite[c] <= hi), F.struct(F.lit(i).alias("i"), *what(c, lo, hi))) for i, (c, lo, hi, _, _) in enumerate(now)]
        rows = df.select(F.explode(F.array_compact(F.array(*at))).alias("r")).select("r.*")
        out: dict[int, list] = {}
        for r in rows.groupBy("i", *keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i", *keys).collect():
            out.setdefault(r.i, []).append(r)
        return out

    def bucket(c: str, lo: float, hi: float) -> tuple:
        share = (finite[c] / 2 - lo / 2) / (hi / 2 - lo / 2)
        return F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("b"), finite[c].alias("x")

    close: set[tuple] = set()
    while open_:
        for k, v in list(open_.items()):
            if v[0] == v[1]:
                got[k] = v[0]
                del open_[k]
            elif v[1] / 2 - v[0] / 2 == 0.0:
                close.add((k[0], *v))
        wide = sorted({(c, *v) for (c, _), v in open_.items() if v[3] > small and (c, *v) not in close})
        if not wide:
            break
        settle(wide, counted(wide, bucket, "b"), narrow)
    few = sorted({(c, *v) for (c, _), v in open_.items()})
    if few:
        settle(few, counted(few, lambda c, lo, hi: (finite[c].alias("x"),), "x"), take)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n = row[f"{i}n"]
        out[c] = []
        for p in ps:
            h = (n - 1) * p
            low, high = (got[c, int(h)], got[c, -int(-h // 1)]) if n else (None, None)
            part = h - int(h)
            out[c].append(low if low is None or low == high or not part else low * (1 - part) + high * part if abs(high / 2 - low / 2) > 1e307 else low + (high - low) * part)
    return out


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), distinct: bool = True) -> DataFrame:
    """Count, distinct values (if asked for), mean, sample deviation and exact quartiles of each column.

    With ``by`` for each group, of which there may be any number of any size (``grouped.describe``).
    """
    if not by:
        with held(df, cols) as x:
            row = x.agg(*[f.alias(f"{i}{n}") for i, c in enumerate(cols) for n, f in (("n", F.count(c)), ("mean", F.avg(F.col(c).cast("double"))), ("std", F.stddev_samp(F.col(c).cast("double"))), ("lo", F.min(F.col(c).cast("double"))), ("hi", F.max(F.col(c).cast("double"))))]).first()
            q = held_quantiles(x, cols, (0.25, 0.5, 0.75))
            seen: dict[str, int] = {}
            if distinct:
                each = None
                for c in cols:  # a distinct for each column, added up before the shuffle
                    one = x.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count("*").alias("n")).select(F.lit(c).alias("variable"), "n")
                    each = one if each is None else each.unionByName(one)
                seen = {r.variable: r.n for r in each.collect()}
        rows = [(c, row[f"{i}n"], *([seen[c]] if distinct else []), row[f"{i}mean"], row[f"{i}std"], row[f"{i}lo"], *q[c], row[f"{i}hi"]) for i, c in enumerate(cols)]
        kinds = "variable string, count long, " + ("nunique long, " if distinct else "") + "mean double, std double, min double, p25 double, p50 double, p75 double, max double"
        return df.sparkSession.createDataFrame(rows, kinds)
    from kilnframe.operators import grouped

    return grouped.describe(df, cols, by)


def variable_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two distinct values: binary; else castable to a number: numeric; else to a date: date; else symbolic.

    Two passes of one aggregation: a column has two values if its extremes
    differ and nothing lies between them.
    """
    ends = df.agg(*[f(c).alias(f"{c}__{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    aggs = []
    for c in cols:
        s, lo, hi = F.col(c).cast("string"), F.col(f"{c}__lo"), F.col(f"{c}__hi")
        aggs += [(F.bool_or(lo != hi) & (F.count_if((F.col(c) != lo) & (F.col(c) != hi)) == 0)).alias(f"{c}__two"), F.count(c).alias(f"{c}__n"), F.count(s.try_cast("double")).alias(f"{c}__f"), F.count(F.try_to_timestamp(s)).alias(f"{c}__t")]
    got = long_form(df.select(*cols).crossJoin(F.broadcast(ends)).agg(*aggs), cols, ("two", "n", "f", "t"))
    return got.select("variable", F.when(F.col("two"), "binary").when(F.col("f") == F.col("n"), "numeric").when(F.col("t") == F.col("n"), "date").otherwise("symbolic").alias("type"))


def missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__missing") for c in cols])
    return long_form(row, cols, ("missing",)).where("missing > 0")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def histogram(df: DataFrame, col: str, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins, the last one closed; by default ``max(10, min(100, int(range / 1000)))`` of them. With ``by`` each group has its own range."""
    x = F.col(col).cast("double")
    s = df.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    k = F.lit(bins) if bins else F.greatest(F.lit(10), F.least(F.lit(100), ((F.col("hi") - F.col("lo")) / 1000).cast("int")))
    s = s.withColumn("bins", k.cast("int"))
    i = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)).cast("int")
    met = df.where(x.isNotNull()).join(s, list(by)) if by else df.where(x.isNotNull()).crossJoin(F.broadcast(s))
    return met.groupBy(*by, i.alias("bin"), "lo", "hi", "bins").agg(F.count("*").alias("n")).select(*by, "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.col("bins")).alias("left_edge"), "n")


def pair_counts(df: DataFrame, cols: Sequence[str], bins: int = 10, target: str | None = None) -> DataFrame:
    """``(v1, v2[, target], x_bin, y_bin, n)``: how the rows of each pair of columns lie in equal bins of their ranges, empty cells left out.

    Two passes: the ranges, then counts that each task adds up in tables of bins
    by bins (as products of indicator matrices, for any number of columns). A row
    counts for a pair if both values are finite; ``target`` is a whole number, of
    which a task holds a table for each value it meets, null among them.
    """
    names = sorted(cols)
    d = len(names)
    x = [F.col(c).cast("double") for c in names]
    x = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(n) for n, c in zip(names, x)]
    row = df.select(*x).agg(F.array(*[F.min(c) for c in names]).alias("lo"), F.array(*[F.max(c) for c in names]).alias("hi")).first()
    lo, hi = (np.array([np.nan if v is None else v for v in r], float) for r in (row.lo, row.hi))
    i, j = np.triu_indices(d, 1)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[object, np.ndarray] = {}
        for pdf in it:
            of = pdf["_of"].astype("Int64")
            for k in of.unique():
                v = pdf.loc[of.isna() if pd.isna(k) else (of == k).fillna(False), names].to_numpy(float)
                with np.errstate(invalid="ignore", divide="ignore"):
                    b = np.where(hi == lo, 0, np.minimum(np.floor((v - lo) / (hi - lo) * bins), bins - 1))
                flat = np.concatenate([(b == c) & ~np.isnan(v) for c in range(bins)], 1).astype(np.float32)
                t = total.setdefault(None if pd.isna(k) else int(k), np.zeros((bins * d, bins * d), np.int64))
                for a in range(0, len(flat), 1 << 20):
                    t += np.rint(flat[a : a + (1 << 20)].T @ flat[a : a + (1 << 20)]).astype(np.int64)
        for k, t in total.items():
            cell = t.reshape(bins, d, bins, d)[:, i, :, j]  # pair, bin of v1, bin of v2
            p, p1, p2 = np.nonzero(cell)
            out = pd.DataFrame({"i": i[p], "j": j[p], "_of": k, "x_bin": p1, "y_bin": p2, "n": cell[p, p1, p2]})
            yield out.astype({"_of": "Int64"})

    part = df.select(*x, (F.col(target) if target else F.lit(0)).cast("long").alias("_of")).mapInPandas(count, "i int, j int, _of long, x_bin int, y_bin int, n long")
    t = part.groupBy("i", "j", "_of", "x_bin", "y_bin").agg(F.sum("n").alias("n"))
    at = F.array(*[F.lit(c) for c in names])
    return t.select(at[F.col("i")].alias("v1"), at[F.col("j")].alias("v2"), *([F.col("_of").alias(target)] if target else []), "x_bin", "y_bin", "n")


def thresholds(df: DataFrame, cols: Sequence[str], std_k: float = 2.0, iqr_k: float = 1.5) -> DataFrame:
    """Per variable the bounds by deviation and by quartile distance."""
    d = describe(df, cols, distinct=False)
    iqr = F.col("p75") - F.col("p25")
    return d.select("variable", (F.col("mean") - std_k * F.col("std")).alias("std_low"), (F.col("mean") + std_k * F.col("std")).alias("std_top"), (F.col("p25") - iqr_k * iqr).alias("iqr_low"), (F.col("p75") + iqr_k * iqr).alias("iqr_top"))


def outlier_counts(df: DataFrame, cols: Sequence[str], std_k: float = 2.0, iqr_k: float = 1.5) -> DataFrame:
    t = {r.variable: r for r in thresholds(df, cols, std_k, iqr_k).collect()}  # one row a column
    aggs = []
    for c in cols:
        for kind in ("std", "iqr"):
            low, top = t[c][f"{kind}_low"], t[c][f"{kind}_top"]
            aggs.append(F.sum(F.coalesce(((F.col(c) > top) | (F.col(c) < low)).cast("long"), F.lit(0))).alias(f"{c}__{kind}"))
    return long_form(df.agg(*aggs), cols, ("std", "iqr")).select("variable", F.col("std").alias("n_std"), F.col("iqr").alias("n_iqr"))


def box(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles and the whiskers: the extreme values within ``k`` quartile distances."""
    t = describe(df, cols, distinct=False).select("variable", "p25", "p50", "p75", (F.col("p25") - k * (F.col("p75") - F.col("p25"))).alias("low"), (F.col("p75") + k * (F.col("p75") - F.col("p25"))).alias("top"))
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])).alias("r")).select("r.*")
    w = x.join(F.broadcast(t), "variable").where("x >= low and x <= top").groupBy("variable").agg(F.min("x").alias("whisker_low"), F.max("x").alias("whisker_high"))
    return t.join(w, "variable", "left").select("variable", "whisker_low", "p25", "p50", "p75", "whisker_high")


def property_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts of several columns in one pass over long rows that are added up before the shuffle."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in cols])).alias("r")).select("r.*")
    return x.where("value is not null").groupBy("property", "value").agg(F.count("*").alias("n"))


def date_parts(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({"year": F.year(col), "quarter": F.quarter(col), "month": F.month(col), "day": F.dayofmonth(col)})


def dms(df: DataFrame, col: str, positive: str, negative: str) -> DataFrame:
    """Hemisphere, degrees (towards zero), minutes and seconds of a coordinate."""
    x = F.abs(F.col(col))
    minutes = (x - F.floor(x)) * 60
    return df.withColumns(
        {
            f"{col}_hemisphere": F.when(F.col(col) >= 0, positive).when(F.col(col) < 0, negative),
            f"{col}_degrees": F.col(col).cast("int"),
            f"{col}_minutes": F.floor(F.round(minutes, 9)).cast("int"),
            f"{col}_seconds": F.round((F.round(minutes, 9) - F.floor(F.round(minutes, 9))) * 60, 4),
        }
    )


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Absolute correlation of each pair ``v1 < v2`` over the rows where both are finite; null for a constant or without such rows.

    One pass: each task adds up counts, sums, squares and products of all pairs
    of its rows, taken from the columns' means; those tables of pairs are summed.
    """
    names = sorted(cols)
    d = len(names)
    x = [F.col(c).cast("double") for c in names]
    x = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(n) for n, c in zip(names, x)]
    mean = [m or 0.0 for m in df.select(*x).agg(*[F.avg(c) for c in names]).first()]
    i, j = np.triu_indices(d, 1)

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, d, d))
        for pdf in it:
            v = pdf.to_numpy(float) - mean
            there = (~np.isnan(v)).astype(float)
            v = np.nan_to_num(v)
            total += [there.T @ there, v.T @ there, there.T @ v, (v * v).T @ there, there.T @ (v * v), v.T @ v]
        yield pd.DataFrame({"i": i, "j": j} | {k: t[i, j] for k, t in zip(("n", "x", "y", "xx", "yy", "xy"), total)})

    part = df.select(*x).mapInPandas(sums, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    t = part.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")])
    vx, vy = F.col("xx") - F.try_divide(F.col("x") * F.col("x"), F.col("n")), F.col("yy") - F.try_divide(F.col("y") * F.col("y"), F.col("n"))
    flat = (vx <= 1e-12 * F.col("xx")) | (vy <= 1e-12 * F.col("yy"))
    r = F.abs(F.try_divide(F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n")), F.sqrt(vx * vy)))
    at = F.array(*[F.lit(c) for c in names])
    return t.select(at[F.col("i")].alias("v1"), at[F.col("j")].alias("v2"), F.when(~flat, r).alias("corr"))


def mirrored(corr: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    return corr.unionByName(corr.select(F.col("v2").alias("v1"), F.col("v1").alias("v2"), "corr"))


def redundant(corr: DataFrame, thresholds: float | Sequence[float], least_partners: int = 2) -> DataFrame:
    """Variables to drop: all partners of a variable that has at least ``least_partners`` correlated ones; for several thresholds a row for each of them."""
    several = not isinstance(thresholds, float)
    at = F.explode(F.array(*[F.lit(float(t)) for t in (thresholds if several else [thresholds])]))
    m = mirrored(corr).withColumn("threshold", at).where(F.col("corr") >= F.col("threshold"))
    many = m.groupBy("threshold", "v1").agg(F.count("*").alias("n")).where(F.col("n") >= least_partners)
    out = m.join(many.select("threshold", "v1"), ["threshold", "v1"], "left_semi").select("threshold", F.col("v2").alias("variable")).distinct()
    return out if several else out.drop("threshold")


def low_variance(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    row = df.agg(*[F.var_samp(c).alias(f"{c}__variance") for c in cols])
    return long_form(row, cols, ("variance",)).where(F.col("variance") < threshold)


def density_fits(df: DataFrame, col: str) -> DataFrame:
    """Normal, exponential and log-moment lognormal parameters by maximum likelihood."""
    x = F.col(col).cast("double")
    return df.agg(F.avg(x).alias("normal_mean"), F.stddev_pop(x).alias("normal_std"), F.min(x).alias("exp_loc"), (F.avg(x) - F.min(x)).alias("exp_scale"), F.avg(F.when(x > 0, F.ln(x))).alias("log_mean"), F.stddev_pop(F.when(x > 0, F.ln(x))).alias("log_std"))


def top_tokens(df: DataFrame, col: str, stop: Sequence[str], n: int = 20) -> DataFrame:
    words = df.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return words.where(~F.col("token").isin(*stop)).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)


def ranked(df: DataFrame, value: str, label: str) -> DataFrame:
    """Labels by falling value; for a short table such as importances."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), label)))
