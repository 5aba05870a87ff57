"""Exact quantiles by group, for any number of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnframe.sources.shared import folder

INF = float("inf")


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], also: Column | None = None) -> DataFrame:
    """An inner join in which a null key equals a null key."""
    there = right.withColumnsRenamed({k: f"{k}__of" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(there[f"{k}__of"]) for k in keys])
    return left.join(there, same if also is None else same & also).drop(*[f"{k}__of" for k in keys])


def long_rows(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``(g0, g1, ..., i, x)``: the groups, the place of the column, and its value, unless it is missing or NaN."""
    groups = [F.col(c).alias(f"g{k}") for k, c in enumerate(by)]
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)])
    return df.select(*groups, F.explode(items).alias("r")).select(*[f"g{k}" for k in range(len(by))], "r.i", "r.x").where("x is not null and not isnan(x)")


def quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], ps: Sequence[float], small: int = 10_000, buckets: int = 512) -> DataFrame:
    """``(<by>, variable, q)``: the interpolated quantiles of each column in each group, exact.

    As ``stats.exact_quantiles``, but the open ranges are a table keyed by group:
    in a round, values are counted by equal buckets of their group's range, and
    the bucket that holds a wanted rank is the range of the next one. A range
    closes when it holds ``small`` rows or one value, so groups close in
    different rounds; the rest of its values are counted one by one. Counts are
    added up before they are shuffled, the table of ranges is written to the
    shared folder, and the driver gets the number of open ranges. A null group
    is a group; a column without values in a group has no row.
    """
    spark = df.sparkSession
    g = [f"g{k}" for k in range(len(by))]
    at, key = [*g, "i"], [*g, "i", "lo", "hi"]
    x = long_rows(df, by, cols)
    finite = F.when(F.abs("x") != INF, F.col("x"))

    def kept(t: DataFrame) -> DataFrame:
        path = folder(spark, "quantiles")
        t.write.parquet(path)
        return spark.read.schema(t.schema).parquet(path)

    size = kept(x.groupBy(*at).agg(F.count("*").alias("n"), F.count_if(F.col("x") == -INF).alias("low"), F.count(finite).alias("m"), F.min(finite).alias("lo"), F.max(finite).alias("hi")))
    places = [f(F.lit(p) * (F.col("n") - 1)).cast("long") for p in ps for f in (F.floor, F.ceil)]
    want = size.withColumn("r", F.explode(F.array_distinct(F.array(*places)))).where("r >= low and r < low + m")
    open_ = want.select(*at, "r", "lo", "hi", F.col("low").alias("before"), F.col("m").alias("n"))
    done = (F.col("n") <= small) | (F.col("lo") == F.col("hi")) | (F.col("hi") / 2 - F.col("lo") / 2 == 0)

    def counted(t: DataFrame, *of: Column | str) -> DataFrame:
        """Values of the ranges of ``t`` by bucket or value, with the ranks before each."""
        ranges = t.select(*key, "before").distinct()
        here = _met(x, ranges, at, F.col("x").between(F.col("lo"), F.col("hi")))
        n = here.groupBy(*key, "before", *of).agg(F.count("*").alias("k"), F.min("x").alias("from"), F.max("x").alias("to"))
        w = Window.partitionBy(*key).orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
        return n.withColumn("first", F.col("before") + F.coalesce(F.sum("k").over(w), F.lit(0))).drop("before")

    def found(t: DataFrame, n: DataFrame) -> DataFrame:
        hit = (F.col("r") >= F.col("first")) & (F.col("r") < F.col("first") + F.col("k"))
        return _met(t, n.select(*key, "from", "to", "first", "k"), key, hit)

    closed = []
    bucket = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets), F.lit(buckets - 1)).alias("b")
    while True:
        closed.append(open_.where(done))
        wide = open_.where(~done)
        if wide.isEmpty():
            break
        open_ = kept(found(wide, counted(wide, bucket)).select(*at, "r", F.col("from").alias("lo"), F.col("to").alias("hi"), F.col("first").alias("before"), F.col("k").alias("n")))
    few = kept(reduce(DataFrame.unionByName, closed))
    got = few.where("lo = hi").select(*at, "r", F.col("lo").alias("v"))
    got = got.unionByName(found(few.where("lo < hi"), counted(few.where("lo < hi"), "x")).select(*at, "r", F.col("from").alias("v")))
    none = lambda kind: F.lit(None).cast(kind)
    rows = size.select(*at, "n", "low", "m", none("long").alias("r"), none("double").alias("v")).unionByName(got.select(*at, none("long").alias("n"), none("long").alias("low"), none("long").alias("m"), "r", "v"))
    t = rows.groupBy(*at).agg(F.max("n").alias("n"), F.max("low").alias("low"), F.max("m").alias("m"), F.map_from_entries(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "v")))).alias("at"))

    def value(r: Column) -> Column:
        return F.when(r < F.col("low"), F.lit(-INF)).when(r >= F.col("low") + F.col("m"), F.lit(INF)).otherwise(F.try_element_at("at", r))

    q = []
    for p in ps:
        h = F.lit(p) * (F.col("n") - 1)
        a, b, part = value(F.floor(h).cast("long")), value(F.ceil(h).cast("long")), h - F.floor(h)
        q.append(F.when((a == b) | (part == 0), a).when(F.abs(b / 2 - a / 2) > 1e307, a * (1 - part) + b * part).otherwise(a + (b - a) * part))
    names = F.array(*[F.lit(c) for c in cols])
    return t.select(*[F.col(k).alias(c) for k, c in zip(g, by)], names[F.col("i")].alias("variable"), F.array(*q).alias("q"))


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Count, distinct values, mean, sample deviation, extremes and exact quartiles of each column in each group."""
    g = [F.col(c).alias(f"g{k}") for k, c in enumerate(by)]
    keys = [f"g{k}" for k in range(len(by))]
    aggs = [F.struct(F.lit(c).alias("variable"), F.count(c).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")) for c in cols for x in (F.col(c).cast("double"),)]
    base = df.groupBy(*g).agg(F.array(*aggs).alias("a")).select(*keys, F.explode("a").alias("a")).select(*keys, "a.*")
    each = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("x")) for c in cols])
    seen = df.select(*g, F.explode(each).alias("r")).select(*keys, "r.*").where("x is not null").distinct().groupBy(*keys, "variable").agg(F.count("*").alias("nunique"))
    q = quantiles(df, by, cols, (0.25, 0.5, 0.75)).withColumnsRenamed(dict(zip(by, keys)))
    parts = base.select("*", F.lit(0).cast("long").alias("nunique"), F.lit(None).cast("array<double>").alias("q"))
    parts = parts.unionByName(seen, allowMissingColumns=True).unionByName(q, allowMissingColumns=True)
    whole = parts.groupBy(*keys, "variable").agg(*[F.max(c).alias(c) for c in ("count", "nunique", "mean", "std", "min", "q", "max")])
    return whole.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "variable", "count", "nunique", "mean", "std", "min", *[F.col("q")[k].alias(n) for k, n in enumerate(("p25", "p50", "p75"))], "max")
