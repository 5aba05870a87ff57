"""Running sums over everything, by ranges of the order instead of one window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnframe.sources.shared import folder

RANGES = 256


def key(df: DataFrame, col: str) -> tuple[Column, str]:
    """The column in a type whose text form keeps its order: instants as microseconds."""
    kind = dict(df.dtypes)[col]
    return (F.unix_micros(col), "bigint") if kind == "timestamp" else (F.col(col), kind)


def cuts(df: DataFrame, col: str, ranges: int = RANGES, each: int = 16) -> list[str]:
    """At most ``ranges - 1`` values, in order, that part the column evenly.

    They are taken from the ``ranges * each`` rows of least hash. Where they lie
    decides how even the ranges are, never a result.
    """
    c, _ = key(df, col)
    some = df.where(F.col(col).isNotNull()).select(c.alias("v"), F.xxhash64(c).alias("h")).orderBy("h").limit(ranges * each)
    v = [r.v for r in some.orderBy("v").select(F.col("v").cast("string").alias("v")).collect()]
    step = max(1, len(v) // ranges)
    return v[step::step][: ranges - 1]


def place(df: DataFrame, col: str, at: list[str]) -> Column:
    """The range of each value, found by halving; -1 for null."""
    c, kind = key(df, col)

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(at[mid]).cast(kind), within(lo, mid)).otherwise(within(mid + 1, hi))

    return F.when(c.isNull(), F.lit(-1)).otherwise(within(0, len(at)))


def running(df: DataFrame, by: str, sums: Mapping[str, str], falling: bool = False, ranges: int = RANGES) -> tuple[DataFrame, dict[str, int]]:
    """``df`` with sums of whole-number columns over all rows up to each one, and the sums of all rows.

    ``sums`` maps a column to the name of its running sum. ``by`` holds each
    value once; null comes first, or last if ``falling``. Rows are summed by
    ranges of ``by``; what comes before a range is one number, and a window
    runs within each range. ``df`` is written once to the shared folder.
    """
    path = folder(df.sparkSession, "ranges")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    r = "_range" + "_" * max(len(c) for c in [*df.columns, *sums.values()])
    x = df.withColumn(r, place(df, by, cuts(df, by, ranges)))
    per = {v[r]: v for v in x.groupBy(r).agg(*[F.sum(c).alias(c) for c in sums]).collect()}  # at most ranges + 1 rows
    before: dict[str, dict[int, int]] = {c: {} for c in sums}
    total = dict.fromkeys(sums, 0)
    for i in sorted(per, reverse=falling):
        for c in sums:
            before[c][i] = total[c]
            total[c] += per[i][c] or 0
    w = Window.partitionBy(r).orderBy(F.desc(by) if falling else F.asc(by)).rowsBetween(Window.unboundedPreceding, 0)
    base = {c: F.array(*[F.lit(before[c].get(i, 0)).cast("long") for i in range(-1, ranges)])[F.col(r) + 1] for c in sums}
    return x.withColumns({n: base[c] + F.sum(c).over(w) for c, n in sums.items()}).drop(r), total
