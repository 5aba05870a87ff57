"""Sharding by extendible hashing.

A directory maps prefixes of a 60-bit hash to shards. A shard over the byte
limit is split on one more bit until each shard fits, so the depth differs from
shard to shard. The directory is derived from byte sums of fine prefixes, which
are few; only documents of a prefix that is still too large are hashed further.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, saved

BITS = 60


def _split(rows: DataFrame, limit: int, first: int) -> tuple[DataFrame, DataFrame]:
    """``rows(row, h, n_bytes)`` to ``(row, depth, prefix)`` of those that fit, and the rows of what doesn't even with all bits."""
    done, left, low, high = None, rows, 0, min(first, BITS)
    while True:
        at = F.shiftright("h", BITS - high)
        leaf = saved(left.groupBy(at.alias("leaf")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
        by = leaf.select("leaf", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(leaf, cast({high} - depth as int))"))
        fits = by.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).where(f"b <= {limit} or n = 1")
        chosen = by.select("leaf", "depth", "prefix").join(fits.select("depth", "prefix"), ["depth", "prefix"]).groupBy("leaf").agg(F.min("depth").alias("depth"))
        chosen = saved(leaf.select("leaf").join(chosen, "leaf", "left"))
        got = left.withColumn("leaf", at).join(chosen, "leaf")
        part = got.where("depth is not null").select("row", "depth", F.expr(f"shiftright(leaf, cast({high} - depth as int))").alias("prefix"))
        done = part if done is None else done.unionByName(part)
        if not chosen.where("depth is null").limit(1).count():
            return done, left.limit(0)
        left = saved(got.where("depth is null").select("row", "h", "n_bytes"))
        if high == BITS:
            return done, left
        low, high = high + 1, min(high + 8, BITS)


def bits(prefix: str, depth: str) -> F.Column:
    return F.expr(f"if({depth} = 0, '', lpad(bin({prefix}), cast({depth} as int), '0'))")


def _placed(docs: DataFrame, limit_bytes: int, key: str, row: F.Column) -> DataFrame:
    """``(row, k, n_bytes, shard, depth)``; ``row`` tells the rows of ``docs`` apart."""
    rows = saved(
        docs.select(
            F.col(key).alias("k"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long").alias("h"),
            row.alias("row"),
        )
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first = max(1, math.ceil(math.log2(max(1, total / limit_bytes))) + 5)
    done, hot = _split(rows.select("row", "h", "n_bytes"), limit_bytes, first)
    placed = done.select("row", bits("prefix", "depth").alias("shard"), F.col("depth").cast("int").alias("depth"))
    if hot.limit(1).count():
        again = hot.select("row", "n_bytes", F.col("h").alias("h0"), F.shiftrightunsigned(F.xxhash64("row"), 64 - BITS).alias("h"))
        sub, rest = _split(again.select("row", "h", "n_bytes"), limit_bytes, 20)
        deep = sub.unionByName(rest.select("row", F.lit(BITS).cast("int").alias("depth"), F.col("h").alias("prefix")))
        deep = deep.join(again.select("row", "h0"), "row")
        placed = placed.unionByName(deep.select("row", F.concat(bits("h0", str(BITS)), bits("prefix", "depth")).alias("shard"), (F.lit(BITS) + F.col("depth")).cast("int").alias("depth")))
    return saved(rows.join(placed, "row").select("row", "k", "n_bytes", "shard", "depth"))


def assign(docs: DataFrame, limit_bytes: int, key: str = "doc_id") -> DataFrame:
    """``(key, n_bytes, shard, depth, shard_bytes, shard_docs)`` for each row of ``docs``.

    ``shard`` is the bit prefix, as text: empty if everything fits in one shard.
    Bytes are those of the UTF-8 text (null: 0). A single text over the limit is
    a shard of its own. Rows with the same key share all 60 bits; if they don't
    fit, bits of a hash of the row itself follow, so a key that holds a third of
    all rows is split like any other shard. A null key hashes as the text
    ``null``.
    """
    got = _placed(docs, limit_bytes, key, F.monotonically_increasing_id()).withColumnRenamed("k", key)
    sums = got.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return got.join(sums, "shard").select(key, "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def directory(assigned: DataFrame) -> DataFrame:
    """One row for each shard: ``(shard, depth, shard_bytes, shard_docs)``."""
    return assigned.select("shard", "depth", "shard_bytes", "shard_docs").distinct()


def write(docs: DataFrame, limit_bytes: int, path: str, key: str = "doc_id") -> None:
    """The rows of ``docs``, each once, as Parquet, a folder ``shard=b<bits>`` for each shard; rows of a shard go to one task, which the limit bounds. If ``docs`` has a column ``shard``, the folders are named ``shard_``."""
    row, shard = free(docs.columns, "_row", "shard")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    placed = _placed(numbered, limit_bytes, key, F.col(row)).select(F.col("row").alias(row), F.concat(F.lit("b"), "shard").alias(shard))
    numbered.join(placed, row).drop(row).repartition(shard).write.partitionBy(shard).mode("overwrite").parquet(path)


#: A shard of the query: small, so that small tables are split as large ones are.
LIMIT = 256 << 10


def query(docs: DataFrame) -> DataFrame:
    return assign(docs, LIMIT)


def sql(limit_bytes: int = LIMIT, deepest: int = 24) -> str:
    return f"""WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT doc_id, n_bytes, h, depth, sum(n_bytes) OVER w AS b, count(*) OVER w AS n FROM d, generate_series(0, {deepest}) AS g(depth) WINDOW w AS (PARTITION BY depth, h >> ({BITS} - depth))),
f AS (SELECT doc_id, n_bytes, h, depth, b, n FROM s WHERE b <= {limit_bytes} OR n = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(to_binary(h >> ({BITS} - depth)), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth, CAST(b AS BIGINT) AS shard_bytes, CAST(n AS BIGINT) AS shard_docs FROM f"""
