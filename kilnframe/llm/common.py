"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: F.Column) -> DataFrame:
    """``doc_id`` and whole ``text`` (null: empty), whatever else the table holds. Rows without a ``doc_id`` take no part."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def free(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores added until no column is called so, for columns of our own beside a caller's."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = got.get() if got.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="kilnframe-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back.

    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kilnframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folders that ``saved`` wrote for ``df``, which is not read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[1].startswith("kilnframe-"):
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in each Arrow batch, so that wide rows (texts, packed runs) stay within a worker's memory.

    The session keeps the setting, as a plan reads it when it runs.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole_groups(it: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups of ``key`` from a partition sorted by it.

    What is carried over is never more than one group and one batch.
    """
    held: list[pd.DataFrame] = []
    for pdf in it:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cut = int(np.flatnonzero(k[:-1] != k[1:])[-1]) + 1 if (k[:-1] != k[1:]).any() else 0
        if cut == 0 and held and held[-1][key].iloc[-1] != k[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        if cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def components(edges: DataFrame, vertices: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """``(id, component_id)``: the smallest id that is reachable over ``edges(u, v)``.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each
    round is two joins-free groupings of the edge list, written to the shared
    folder; the number of edges never grows. A vertex without an edge is left
    out unless ``vertices(id)`` names it.
    """
    e = saved(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        nxt = saved(small.where("u <> v").distinct())
        # a star forest: no vertex is both a leaf and a centre, and each leaf has one centre
        bad = nxt.groupBy("u").count().where("count > 1").select("u").union(nxt.select("u").intersect(nxt.select("v"))).limit(1).count()
        e = nxt
        if not bad:
            break
    else:
        raise RuntimeError("components() did not settle")
    leaf = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    root = e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    found = leaf.union(root)
    if vertices is None:
        return found
    return vertices.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))
