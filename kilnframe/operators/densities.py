"""Histograms as densities beside fitted distributions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnframe.operators.stats import histogram


def _finite(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col).cast("double")
    return df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def lognormal(df: DataFrame, col: str, rounds: int = 5, points: int = 16) -> dict[str, float] | None:
    """Shift, log mean, log deviation and mean log likelihood of a shifted lognormal; None without two different values.

    For a shift, mean and deviation of ``ln(x - shift)`` are the best ones, so
    only the shift is searched: ``min - range * 10 ** u`` for ``points`` values of
    ``u``, then closer around the best one, an aggregation for each round. As
    the shift nears the least value the likelihood has no bound, so ``u`` starts
    at -6; it ends at 3, where the fit is a normal one. Shift 0 is tried too if
    all values are positive, so the fit is never worse than the unshifted one.
    """
    x = _finite(df, col)
    row = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if row.lo is None or row.lo == row.hi:
        return None
    span = row.hi - row.lo
    low, high = -6.0, 3.0
    best: tuple[float, float, float, float, float] | None = None
    for k in range(rounds):
        us = [low + (high - low) * i / (points - 1) for i in range(points)]
        shifts = [(u, row.lo - span * 10.0**u) for u in us]
        if not k and row.lo > 0:
            shifts.append((min(3.0, max(-6.0, math.log10(row.lo / span))), 0.0))
        got = x.agg(*[f(F.ln(F.col("x") - s)).alias(f"{n}{i}") for i, (_, s) in enumerate(shifts) for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
        for i, (u, s) in enumerate(shifts):
            m, d = got[f"m{i}"], got[f"d{i}"]
            if d:
                fit = (-math.log(d) - m - 0.5 - 0.5 * math.log(2 * math.pi), u, s, m, d)
                best = fit if best is None or fit[0] > best[0] else best
        if best is None:
            return None
        step = (high - low) / (points - 1)
        low, high = max(-6.0, best[1] - step), min(3.0, best[1] + step)
    return {"shift": best[2], "log_mean": best[3], "log_std": best[4], "likelihood": best[0]}


def densities(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """``(bin, left_edge, center, n, density, normal, exponential, lognormal)``: equal bins, each with the fitted densities at its centre.

    Values that are missing or not finite don't count; bins without values are
    left out, and a fit that the values don't allow is null.
    """
    x = _finite(df, col)
    r = x.agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    none = F.lit(None).cast("double")
    h = histogram(x, "x", bins)
    width = (r.hi - r.lo) / bins if r.n else 0.0
    c = F.col("left_edge") + width / 2
    out = h.select("bin", "left_edge", c.alias("center"), "n")
    c = F.col("center")
    root = math.sqrt(2 * math.pi)
    fit = lognormal(x, "x") if width else None
    scale = r.m - r.lo if r.n else 0.0
    z = (F.ln(c - fit["shift"]) - fit["log_mean"]) / fit["log_std"] if fit else None
    return out.select(
        "*",
        (F.col("n") / (r.n * width) if width else none).alias("density"),
        (F.exp(-F.pow((c - r.m) / r.d, 2) / 2) / (r.d * root) if r.d else none).alias("normal"),
        (F.exp(-(c - r.lo) / scale) / scale if scale else none).alias("exponential"),
        (F.exp(-z * z / 2) / ((c - fit["shift"]) * fit["log_std"] * root) if fit else none).alias("lognormal"),
    )
