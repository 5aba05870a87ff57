"""Encodings as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnframe.operators.ranges import running


def ordinal(c: Column | str, ranks: Mapping[str, float]) -> Column:
    """The rank of a listed value; null for any other."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for k, v in ranks.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def listed(c: Column | str, values: Sequence[str], other: str = "UNKNOWN") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*values), c).otherwise(other)


def below(c: Column | str, limit: float, yes: str, no: str) -> Column:
    """``yes`` under the limit, else ``no``, also for null."""
    return F.when((F.col(c) if isinstance(c, str) else c) < limit, yes).otherwise(no)


def codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """The place of each value among the sorted distinct ones, from 0; null stays null.

    Distinct values are ranked apart, by ranges of them; the rows are joined to them.
    """
    v = df.select(col).where(F.col(col).isNotNull()).distinct().select(F.col(col).alias("v"), F.lit(1).alias("one"))
    ranked, _ = running(v, "v", {"one": "upto"})
    return df.join(ranked.select(F.col("v").alias(col), (F.col("upto") - 1).cast("long").alias(out)), col, "left")


def combined_code(df: DataFrame, col: str, out: str, prefix: int = 3) -> DataFrame:
    """Code of the first characters times a power of ten, plus the code of the trimmed rest."""
    x = df.withColumn("_p", F.substring(col, 1, prefix)).withColumn("_s", F.expr(f"trim(substring({col}, {prefix + 1}))"))
    x = codes(codes(x, "_p", "_pc"), "_s", "_sc")
    n = df.select(F.expr(f"trim(substring({col}, {prefix + 1}))").alias("s")).agg(F.count_distinct("s").alias("n"))
    m = n.select(F.pow(F.lit(10.0), F.ceil(F.log10(F.greatest(F.col("n"), F.lit(1))))).cast("long").alias("_m"))
    return x.crossJoin(F.broadcast(m)).withColumn(out, F.col("_pc") * F.col("_m") + F.col("_sc")).drop("_p", "_s", "_pc", "_sc", "_m")


def cyclic(c: Column | str, period: float) -> tuple[Column, Column]:
    x = F.lit(2.0) * F.pi() * (F.col(c) if isinstance(c, str) else c) / F.lit(float(period))
    return F.sin(x), F.cos(x)


def cyclic_by_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sine and cosine with the column's largest value as period, to three digits."""
    top = df.agg(*[F.max(c).alias(c) for c in cols]).first()
    new = {}
    for c in cols:
        s, k = cyclic(c, top[c])
        new |= {f"{c}_sin": F.round(s, 3), f"{c}_cos": F.round(k, 3)}
    return df.withColumns(new)


def one_hot(df: DataFrame, cols: Sequence[str], most: int = 1_000) -> DataFrame:
    """A flag for each value, false for null; of two values only the second gets one.

    A column of more than ``most`` values raises, as each value is a column.
    """
    flags = {}
    for c in cols:
        values = [r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} values")
        for v in values[1:] if len(values) == 2 else values:
            flags[f"{c}_{v}"] = F.coalesce(F.col(c).cast("string") == v, F.lit(False))
    return df.withColumns(flags).drop(*cols)


def has_words(df: DataFrame, col: str, words: Sequence[str], prefix: str) -> DataFrame:
    """For each word a 0/1 flag: the text holds it somewhere, in any case."""
    return df.withColumns({f"{prefix}_HAS_{w.upper()}": F.coalesce(F.contains(F.lower(F.col(col)), F.lit(w)).cast("int"), F.lit(0)) for w in words})
