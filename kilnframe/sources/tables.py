"""Readers, writers and the stand-in datasets that the queries run on."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingTarget(ValueError):
    """The named target is not a column."""


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column, so comparisons and aggregates skip it."""
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_csv(spark: SparkSession, path: str, target: str | None = None, schema: str | None = None, sep: str = ",", ts: str | None = None, ts_format: str | None = None) -> DataFrame:
    """A CSV scan; a bad path or a missing target raises. ``ts`` is parsed to a timestamp, bad values to null."""
    r = spark.read.option("header", True).option("sep", sep)
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    if ts:
        c = F.col(ts).cast("string")
        df = df.withColumn(ts, (F.try_to_timestamp(c, F.lit(ts_format)) if ts_format else F.try_to_timestamp(c)).cast("timestamp_ntz"))
    if target is not None and target not in df.columns:
        raise MissingTarget(target)
    return clean_nan(df)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_tag(path: str) -> str:
    """The base name up to its first dot."""
    return path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]


def both_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """One frame with ``split`` in place of two."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of mixed types with nulls and a binary target; ``row_id`` is unique."""
    li, o, c, p = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey)

    def gap(col: str, k: int) -> F.Column:
        return F.when(F.col("l_partkey") % k == 0, None).otherwise(F.col(col))

    return j.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("row_id"),
        "l_quantity", "l_extendedprice", "l_discount", gap("l_tax", 13).alias("l_tax"), "o_totalprice", F.col("l_shipdate").alias("event_date"),
        F.col("p_brand").alias("code"), gap("p_name", 17).alias("text"), F.col("l_linestatus").alias("cat"), F.col("c_mktsegment").alias("boro"), gap("o_orderpriority", 11).alias("band"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
    )


MIXED_SQL = """mixed AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
  l_quantity, l_extendedprice, l_discount, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_tax END AS l_tax, o_totalprice, l_shipdate AS event_date, p_brand AS code,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE p_name END AS text, l_linestatus AS cat, c_mktsegment AS boro, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS band,
  CAST(l_returnflag = 'R' AS INT) AS target
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Order value a day: ``(ts, y, x)``, of urgent orders and of all others."""
    o = table(spark, d, "orders")
    urgent = F.col("o_orderpriority").startswith("1")
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    return o.groupBy(day.alias("ts")).agg(F.coalesce(F.sum(F.when(urgent, F.col("o_totalprice"))), F.lit(0.0)).alias("y"), F.coalesce(F.sum(F.when(~urgent, F.col("o_totalprice"))), F.lit(0.0)).alias("x"))


DAILY_SQL = """daily AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, coalesce(sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END), 0.0) AS y,
  coalesce(sum(CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_totalprice END), 0.0) AS x FROM orders GROUP BY 1)"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    from kilnframe.operators.series import aggregate

    return aggregate(daily(spark, d), "M", {"y": "sum", "x": "sum"})


MONTHLY_SQL = DAILY_SQL + ",\nmonthly AS (SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts, sum(y) AS y, sum(x) AS x FROM daily GROUP BY 1)"


def wide(spark: SparkSession, d: str, dims: Iterable[int] = range(16)) -> DataFrame:
    """Embedding components as columns, with a binary target."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in dims], (F.col("label") == 0).cast("int").alias("target"))


def wide_sql(dims: Iterable[int] = range(16)) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in dims)
    return f"wide AS (SELECT vec_id, {cols}, CAST(label = 0 AS INT) AS target FROM embeddings)"


def geo(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 19 == 0, None).otherwise(F.col("c_acctbal") / 111.0).alias("lat"), ((F.col("c_custkey") % 360) - 180 + 0.25).cast("double").alias("lon"))


GEO_SQL = "geo AS (SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_acctbal / 111.0 END AS lat, CAST((c_custkey % 360) - 180 + 0.25 AS DOUBLE) AS lon FROM customer)"


def literal_map(values: Mapping[str, object]) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
