"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic). The cells' token
weights are raked in turn to the target share of each source, language and
topic until all three marginals hold. A document is then sampled with
probability ``min(1, rate * weight of its cell)``, where ``rate`` is the one
number for which the expected tokens are the budget. DataFrame operations only.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free, saved

DIMS = ("source", "lang", "topic")
#: Symbols of markup and code.
SYMBOLS = "{}<>[]|=_#*$%&^~"


def text_topic(text: Column) -> Column:
    """A topic from the whole text: what its characters say it is made of."""
    n = F.greatest(F.length(text), F.lit(1))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(symbols * 50 >= n, "markup").when(digits * 50 >= n, "records").when(lines * 100 >= n, "lists").otherwise("prose")


def measured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens)``; a null source, language or topic is the value ``(none)``, a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit("(none)")
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), none).alias("source"),
        F.coalesce(F.col("lang").cast("string"), none).alias("lang"),
        F.coalesce(topic if topic is not None else text_topic(text), none).alias("topic"),
        F.regexp_count(text, F.lit("[^ \t\n\r]+")).cast("long").alias("n_tokens"),
    )


def tempered(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """Target shares of a dimension: its token shares to the power ``alpha``, made to add up to 1."""
    s = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), alpha).alias("p"))
    return s.crossJoin(F.broadcast(s.agg(F.sum("p").alias("all")))).select(dim, (F.col("p") / F.col("all")).alias(f"target_{dim}"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = 0.5, tolerance: float = 1e-10, most_rounds: int = 60) -> DataFrame:
    """``cells`` with ``weight``, by which its tokens count.

    ``targets[dim][value]`` are shares; a dimension that isn't named gets
    ``tempered`` ones; a value that isn't named gets no weight. Cells without
    tokens keep the weight 1.
    """
    spark = cells.sparkSession
    full = cells.where("tokens > 0")
    t = full
    for d in DIMS:
        if targets and d in targets:
            rows = [(str(k), float(v) / sum(targets[d].values())) for k, v in targets[d].items()]
            goal = spark.createDataFrame(rows, f"{d} string, target_{d} double")
        else:
            goal = tempered(full, d, alpha)
        t = t.join(goal, d, "left").fillna(0.0, [f"target_{d}"])
    t = saved(t.withColumn("mass", F.col("tokens").cast("double")))
    n, total = t.agg(F.count("*"), F.sum("tokens")).first()
    t = t.repartition(-(-n // 100_000) or 1)  # the windows of few cells then need no exchange
    rounds, off = 0, 1.0
    while total and rounds < most_rounds and off > tolerance:
        for _ in range(5):
            for d in DIMS:
                w = F.sum("mass").over(Window.partitionBy(d))
                t = t.withColumn("mass", F.when(w > 0, F.col("mass") * F.col(f"target_{d}") * total / w).otherwise(F.lit(0.0)))
        t, rounds = saved(t).repartition(-(-n // 100_000) or 1), rounds + 5
        far = [F.abs(F.sum("mass").over(Window.partitionBy(d)) / total - F.col(f"target_{d}")) for d in DIMS[:2]]
        off = t.select(F.greatest(*far).alias("x")).agg(F.max("x")).first()[0]
    if total and off > 1e-6:
        warnings.warn(f"marginals are still off by {off:.2g} after {rounds} rounds; they may contradict each other", stacklevel=2)
    w = t.select(*DIMS, (F.col("mass") / F.col("tokens")).alias("weight"))
    return cells.join(w, list(DIMS), "left").fillna(1.0, ["weight"])


def rated(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` with ``probability``: ``min(1, rate * weight)``, expected tokens being ``budget`` of all tokens.

    The window holds the cells, never documents.
    """
    down = Window.orderBy(F.desc("weight"), *DIMS)
    past = down.rowsBetween(Window.unboundedPreceding, -1)
    c = cells.withColumn("mass", F.col("tokens") * F.col("weight"))
    c = c.withColumn("taken", F.coalesce(F.sum("tokens").over(past), F.lit(0))).withColumn("spent", F.coalesce(F.sum("mass").over(past), F.lit(0.0)))
    c = c.crossJoin(F.broadcast(cells.agg(F.sum("tokens").alias("all_tokens"), F.sum(F.col("tokens") * F.col("weight")).alias("all_mass"))))
    r = (F.col("all_tokens") * budget - F.col("taken")) / F.nullif(F.col("all_mass") - F.col("spent"), F.lit(0.0))
    c = c.withColumn("r", F.when((r * F.col("weight") <= 1) & (F.col("weight") > 0), r))
    rate = c.agg(F.max("r").alias("rate"))
    return cells.crossJoin(F.broadcast(rate)).withColumn("probability", F.least(F.lit(1.0), F.when(F.lit(budget >= 1), F.when(F.col("weight") > 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.col("rate") * F.col("weight"), F.lit(1.0))))).drop("rate")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from an id and a seed."""
    h = F.md5(F.concat(doc_id.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def _cells(m: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, alpha: float, budget: float) -> DataFrame:
    cells = m.groupBy(*DIMS).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    return saved(rated(rake(cells, targets, alpha), budget).select(*DIMS, "weight", "probability"))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = 0.5, budget: float = 0.5, seed: int = 42, topic: Column | None = None) -> DataFrame:
    """One row for each document: its cell, ``weight``, ``probability`` and whether it is ``selected``.

    Rows that share an id, and rows without one, draw the same number, but each
    is held against the probability of its own cell. The cells are as many as sources times languages
    times topics that occur; Spark broadcasts them only if they are small.
    """
    m = saved(measured(docs, topic))
    cells = _cells(m, targets, alpha, budget)
    u = uniform(F.coalesce(F.col("doc_id"), F.lit(-1)), seed)
    return m.join(cells, list(DIMS)).select("doc_id", *DIMS, "n_tokens", "weight", "probability", (u < F.col("probability")).alias("selected"))


def query(docs: DataFrame) -> DataFrame:
    got = mix(docs)
    return got.withColumns({c: F.round(c, 5) for c in ("weight", "probability")})


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = 0.5, budget: float = 0.5, seed: int = 42, topic: Column | None = None) -> DataFrame:
    """The selected rows of ``docs``, all their columns; see ``mix``, whose numbers they have. Rows are decided in place; one without an id draws by a hash of all its columns, so equal ones stay or go together."""
    none, text = F.lit("(none)"), F.coalesce(F.col("text"), F.lit(""))
    *dims, p = free(docs.columns, *[f"_{d}" for d in DIMS], "_p")
    cells = _cells(measured(docs, topic), targets, alpha, budget).select(*[F.col(d).alias(n) for d, n in zip(DIMS, dims)], F.col("probability").alias(p))
    own = dict(zip(dims, (F.coalesce(F.col("source").cast("string"), none), F.coalesce(F.col("lang").cast("string"), none), F.coalesce(topic if topic is not None else text_topic(text), none))))
    u = uniform(F.coalesce(F.col("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])), seed)
    return docs.withColumns(own).join(cells, dims).where(u < F.col(p)).select(*[F.col(f"`{c}`") for c in docs.columns])


def sql(alpha: float = 0.5, budget: float = 0.5, seed: int = 42, rounds: int = 60) -> str:
    """The same rows from DuckDB; the rounds are written out."""
    symbols = SYMBOLS.replace("'", "''")
    out = [f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang FROM documents),
m AS (SELECT doc_id, source, lang, CASE
    WHEN (length(text) - length(translate(text, '{symbols}', ''))) * 50 >= greatest(length(text), 1) THEN 'markup'
    WHEN (length(text) - length(translate(text, '0123456789', ''))) * 50 >= greatest(length(text), 1) THEN 'records'
    WHEN (length(text) - length(translate(text, chr(10), ''))) * 100 >= greatest(length(text), 1) THEN 'lists' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens FROM t),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM m GROUP BY ALL),
total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM cells)"""]
    for d in DIMS:
        out.append(f"g_{d} AS (SELECT {d}, pow(sum(tokens), {alpha}) / sum(pow(sum(tokens), {alpha})) OVER () AS target_{d} FROM cells WHERE tokens > 0 GROUP BY {d})")
    out.append("k0 AS (SELECT c.*, CAST(tokens AS DOUBLE) AS mass, target_source, target_lang, target_topic, total FROM cells c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic), total WHERE tokens > 0)")
    n = 0
    for _ in range(rounds):
        for d in DIMS:
            out.append(f"k{n + 1} AS (SELECT * REPLACE (mass * target_{d} * total / sum(mass) OVER (PARTITION BY {d}) AS mass) FROM k{n})")
            n += 1
    out.append(f"""w AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, coalesce(k.mass / k.tokens, 1.0) AS weight FROM cells c LEFT JOIN k{n} k ON c.source = k.source AND c.lang = k.lang AND c.topic = k.topic),
p AS (SELECT *, coalesce(sum(tokens) OVER o, 0) AS taken, coalesce(sum(tokens * weight) OVER o, 0) AS spent, sum(tokens) OVER () AS all_tokens, sum(tokens * weight) OVER () AS all_mass FROM w
  WINDOW o AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT max((all_tokens * {budget} - taken) / nullif(all_mass - spent, 0)) AS rate FROM p WHERE weight > 0 AND (all_tokens * {budget} - taken) / nullif(all_mass - spent, 0) * weight <= 1)
SELECT doc_id, m.source, m.lang, m.topic, n_tokens, round(weight, 5) AS weight, round(least(1.0, coalesce(rate * weight, 1.0)), 5) AS probability,
  CAST('0x' || substr(md5(concat(CAST(doc_id AS VARCHAR), ':{seed}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < least(1.0, coalesce(rate * weight, 1.0)) AS selected
FROM m JOIN w ON m.source = w.source AND m.lang = w.lang AND m.topic = w.topic, r""")
    return ",\n".join(out)
