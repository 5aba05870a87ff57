"""Preparation: each operator fits a few numbers on the training rows and applies them as expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnframe.operators.neighbours import donors, nearest
from kilnframe.operators.stats import exact_quantiles, held, held_quantiles


def fit_scope(df: DataFrame, scope: str) -> DataFrame:
    """The rows that parameters are learned from: ``all``, or those whose ``split`` is ``train``."""
    return df if scope == "all" else df.where("split = 'train'")


def fit_fill(df: DataFrame, numeric: Sequence[str], symbolic: Sequence[str], how: str = "mean", scope: str = "all") -> dict[str, object]:
    """Mean or median of numeric columns and the most frequent value of the others (ties: the smallest)."""
    t = fit_scope(df, scope)
    out: dict[str, object] = {}
    if numeric and how == "mean":
        out |= t.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict()
    elif numeric:
        out |= {c: q[0] for c, q in exact_quantiles(t, numeric, (0.5,)).items()}
    if symbolic:
        x = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in symbolic])).alias("r")).select("r.*")
        n = x.where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
        out |= {r.c: r.v for r in n.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("best")).select("c", F.col("best.v").alias("v")).collect()}
    return out


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna({k: v for k, v in values.items() if v is not None})


def whole(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without a null or NaN in ``cols``, by a condition for each column.

    ``na.drop`` is one condition on all of them: for a plan that renames its
    columns, the optimizer derives a form of it for every subset of the names,
    which 64 columns don't allow.
    """
    kinds, keep = dict(df.dtypes), F.lit(True)
    for c in cols:
        keep = keep & (F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull())
    return df.where(keep)


def drop_sparse(df: DataFrame, least_columns: float = 0.1, least_rows: float = 0.0) -> DataFrame:
    """Drop columns with too few values, then rows with too few values of the columns there were."""
    cols = df.columns
    n = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols]).first()
    kept = [c for c in cols if n[c] >= n["_n"] * least_columns]
    return df.select(*kept).na.drop(thresh=int(len(cols) * least_rows)) if least_rows > 0 else df.select(*kept)


def fit_bounds(df: DataFrame, cols: Sequence[str], k: float = 5.0, scope: str = "all") -> dict[str, tuple[float, float, float]]:
    """Per column: mean - k deviations, mean + k deviations, median."""
    with held(fit_scope(df, scope), cols) as x:
        row = x.agg(*[f(F.col(c).cast("double")).alias(f"{i}{n}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        q = held_quantiles(x, cols, (0.5,))
    return {c: (row[f"{i}m"] - k * row[f"{i}s"], row[f"{i}m"] + k * row[f"{i}s"], q[c][0]) for i, c in enumerate(cols) if row[f"{i}s"] is not None}


def drop_outliers(df: DataFrame, bounds: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """One conjunctive filter; null is no outlier."""
    keep = F.lit(True)
    for c, (low, top, _) in bounds.items():
        keep = keep & ~F.coalesce((F.col(c) > top) | (F.col(c) < low), F.lit(False))
    return df.where(keep)


def replace_outliers(df: DataFrame, bounds: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    return df.withColumns({c: F.when((F.col(c) > top) | (F.col(c) < low), F.lit(mid)).otherwise(F.col(c).cast("double")) for c, (low, top, mid) in bounds.items()})


def truncate_outliers(df: DataFrame, bounds: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) > top, F.lit(top)).when(F.col(c) < low, F.lit(low)).otherwise(F.col(c).cast("double")) for c, (low, top, _) in bounds.items()})


def fit_scale(df: DataFrame, cols: Sequence[str], how: str = "zscore", scope: str = "all") -> dict[str, tuple[float | None, float]]:
    """Per column what to take off and what to divide by: mean and population deviation, or minimum and range; a constant column divides by 1."""
    p = fit_scope(df, scope).agg(*[f(c).alias(f"{c}__{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in cols:
        a, b = (p[f"{c}__m"], p[f"{c}__s"]) if how == "zscore" else (p[f"{c}__lo"], None if p[f"{c}__hi"] is None else p[f"{c}__hi"] - p[f"{c}__lo"])
        out[c] = (a, float(b) if b else 1.0)
    return out


def apply_scale(df: DataFrame, by: Mapping[str, Sequence[float | None]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(a)) / F.lit(b) for c, (a, b) in by.items()})


def scale(df: DataFrame, cols: Sequence[str], how: str = "zscore", scope: str = "all") -> DataFrame:
    """``zscore`` with the population deviation, or ``minmax``; a constant column becomes 0."""
    return apply_scale(df, fit_scale(df, cols, how, scope))


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    return [next(n + "_" * k for k in range(len(taken) + 1) if (n + "_" * k).lower() not in taken) for n in names]


def draw(key: Column | str, seed: int | str) -> Column:
    """A number in [0, 1) from a key: the same on any cluster and for any partitioning."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: top-n by hash, each partition keeping ``n`` at most."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def ranks(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``rank``, from 0, in the order of a hash of ``key``.

    Rows are counted by the first bits of the hash and ranked within them, so
    no task sees all rows. Rows that share a key come next to each other.
    """
    hash_, first, before_, n_ = free(df, "_h", "_b", "_before", "_n")
    x = df.withColumn(hash_, F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    x = x.withColumn(first, F.substring(hash_, 1, 3))
    before = F.coalesce(F.sum(n_).over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = x.groupBy(first).agg(F.count("*").alias(n_)).select(first, before.alias(before_))  # at most 4,096 rows
    r = F.row_number().over(Window.partitionBy(first).orderBy(hash_, key)) - 1
    return x.join(F.broadcast(n), first).withColumn("rank", (F.col(before_) + r).cast("long")).drop(hash_, first, before_)


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int = 42, number: str | None = None) -> DataFrame:
    """``n`` draws from all rows: draw ``i`` takes the row whose rank is ``floor(u(i) * rows)``; ``number`` names a column for ``i``."""
    size = df.count()
    i = [F.col("id").alias(number)] if number else []
    d = df.sparkSession.range(n).select(F.floor(draw("id", seed) * size).cast("long").alias("rank"), *i)
    return d.join(ranks(df, key, seed), "rank").drop("rank")


def split_random(df: DataFrame, key: str, test: float = 0.3, seed: int = 42) -> DataFrame:
    """An exact split: ``ceil(test * n)`` rows are ``test``, those of the smallest hashes.

    Rows are counted by the first bits of the hash; only the bucket where the
    cut falls is ranked, so no task sees all rows.
    """
    hash_, first, place = free(df, "_h", "_b", "_r")
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    x = df.withColumn(hash_, h).withColumn(first, F.substring(hash_, 1, 3))
    per = x.groupBy(first).agg(F.count("*").alias("count")).orderBy(first).collect()  # at most 4,096 rows
    n = sum(r["count"] for r in per)
    want, before, cut, rest = -(-n * int(round(test * 1000)) // 1000), 0, None, 0
    for r in per:
        if before + r["count"] >= want:
            cut, rest = r[first], want - before
            break
        before += r["count"]
    if cut is None:
        return x.withColumn("split", F.lit("train")).drop(hash_, first)
    edge = x.where(F.col(first) == cut).withColumn(place, F.row_number().over(Window.orderBy(hash_, key))).where(F.col(place) <= rest).agg(F.max(F.struct(hash_, key)).alias("top")).first()
    top = edge.top
    last = F.lit(False) if top is None else (F.col(first) == cut) & ((F.col(hash_) < top[0]) | ((F.col(hash_) == top[0]) & (F.col(key) <= top[1])))
    return x.withColumn("split", F.when((F.col(first) < cut) | last, "test").otherwise("train")).drop(hash_, first)


def split_temporal(df: DataFrame, ts: str, train: float = 0.9) -> DataFrame:
    """The first ``floor(n * train)`` rows in time are ``train``."""
    n = df.count()
    r = F.row_number().over(Window.orderBy(ts))
    return df.withColumn("split", F.when(r <= int(n * train), "train").otherwise("test"))


def class_sizes(df: DataFrame, target: str) -> dict[object, int]:
    return {r[target]: r["count"] for r in df.groupBy(target).count().collect()}


def undersample(df: DataFrame, key: str, target: str, seed: int = 42) -> DataFrame:
    """The majority cut to the minority's size, by hash order."""
    n = class_sizes(df, target)
    low = min(n, key=lambda k: (n[k], k))
    parts = [df.where(F.col(target) == low)] + [ranks(df.where(F.col(target) == k), key, seed).where(F.col("rank") < n[low]).drop("rank") for k in sorted(n) if k != low]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oversample(df: DataFrame, key: str, target: str, seed: int = 42) -> DataFrame:
    """The minority drawn with replacement to the majority's size."""
    n = class_sizes(df, target)
    low, top = min(n, key=lambda k: (n[k], k)), max(n, key=lambda k: (n[k], k))
    return df.where(F.col(target) != low).unionByName(sample_with_replacement(df.where(F.col(target) == low), key, n[top], seed))


def smote(df: DataFrame, key: str, cols: Sequence[str], target: str, minority: int, k: int = 5, extra: int | None = 1, seed: int = 42) -> DataFrame:
    """``(key, copy, cols)``: new rows between minority rows and one of their ``k`` nearest minority neighbours.

    ``extra`` for each row; with None as many as make the minority as large as the
    largest class, dealt out evenly: each row gets its share and those of the
    first ranks by hash one more. A row without a missing
    value takes part; a minority of one row has no neighbour and no new rows.
    """
    m = whole(df.where(F.col(target) == minority), [key, *cols]).select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    near = nearest(m, m, key, cols, k, apart=True).where(F.size("near") > 0).select(F.col("key").alias(key), "near")
    if extra is None:
        size = class_sizes(df, target)
        have, more = m.count(), max(size.values(), default=0) - size.get(minority, 0)
        each, rest = divmod(more, have) if have else (0, 0)
        turns = ranks(m.select(key), key, seed).withColumn("n", F.lit(each) + (F.col("rank") < rest).cast("int"))
    else:
        turns = m.select(key).withColumn("n", F.lit(extra))
    new = turns.where("n > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    new = new.withColumn("u", draw(F.concat_ws(":", key, "copy"), f"{seed}u")).withColumn("r", draw(F.concat_ws(":", key, "copy"), f"{seed}n"))
    to = new.join(near, key).select(key, "copy", "u", F.col("near")[F.floor(F.col("r") * F.size("near")).cast("int")]["other"].alias("other"))
    v = F.array(*[F.col(c) for c in cols])
    j = to.join(m.select(key, v.alias("v")), key).join(m.select(F.col(key).alias("other"), v.alias("w")), "other")
    return j.select(key, "copy", *[(F.col("v")[i] + F.col("u") * (F.col("w")[i] - F.col("v")[i])).alias(c) for i, c in enumerate(cols)])


def knn_fill(df: DataFrame, key: str, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Fill a null by the mean of the ``k`` nearest rows that have the value.

    The distance runs over the coordinates both rows have, scaled up to all of
    them; ties go to the smaller key. A gap without a donor, and that of a row
    without a key, stays.
    """
    near = donors(df, key, cols, k)
    mean = F.aggregate("near", F.lit(0.0), lambda s, x: s + x["val"]) / F.size("near")
    fills = near.where(F.size("near") > 0).groupBy(F.col("key").alias("_kiln_key")).agg(F.map_from_entries(F.collect_list(F.struct("slot", mean))).alias("_kiln_fill"))
    met = df.join(fills, F.col(key).cast(dict(fills.dtypes)["_kiln_key"]) == F.col("_kiln_key"), "left")
    return met.select(*[F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), F.col("_kiln_fill")[c]).alias(c) if c in cols else F.col(c) for c in df.columns])


def balanced(df: DataFrame, key: str, cols: Sequence[str], target: str, how: str, seed: int = 42) -> DataFrame:
    """Rows ``(key, cols, target)`` with classes of one size by ``undersampling``, ``oversampling`` or ``smote``.

    ``key`` must be a whole number; drawn and new rows get keys above the
    largest, in an order that doesn't depend on partitioning. SMOTE is for two
    classes and leaves a minority of fewer than two rows as it is.
    """
    x = df.select(key, *cols, target)
    if how == "undersampling":
        return undersample(x, key, target, seed)
    n = class_sizes(x, target)
    if len(n) < 2:
        return x
    low, most, top = min(n, key=lambda k: (n[k], k)), max(n.values()), x.agg(F.max(key)).first()[0]
    if how == "oversampling":
        new = sample_with_replacement(x.where(F.col(target) == low), key, most, seed, "_kiln_draw").withColumn(key, F.col("_kiln_draw") + F.lit(top + 1)).drop("_kiln_draw")
        return x.where(F.col(target) != low).unionByName(new.select(*x.columns))
    new = ranks(smote(x, key, cols, target, low, extra=None, seed=seed).withColumn("_kiln_row", F.concat_ws(":", key, "copy")), "_kiln_row", seed)
    kinds = dict(x.dtypes)
    new = new.withColumn(key, F.col("rank") + F.lit(top + 1)).withColumn(target, F.lit(low).cast(kinds[target]))
    wide = x.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in cols], target)
    return wide.unionByName(new.select(*wide.columns))


def variance_thresholds(most: float, step: float) -> list[float]:
    """``step, 2 * step, ...`` up to ``most``, to three digits."""
    return [round(i * step, 3) for i in range(1, int(-(-most // step) + 1)) if i * step <= most + 1e-9]


def correlation_thresholds(least: float, step: float) -> list[float]:
    out, i = [], 0
    while least + i * step <= 1.0 + 1e-9:
        out.append(round(least + i * step, 3))
        i += 1
    return out
