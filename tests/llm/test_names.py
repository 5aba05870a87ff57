"""Tables whose columns are called as the operators' own: nothing crashes and no value changes."""

import pytest
from pyspark.sql import functions as F

from kilnframe.llm import common, jaccard, mixing, sharding, suffixes

OWN = ("_id", "th", "_th", "_gone", "_p", "_source", "_lang", "_topic", "_row", "shard", "row", "_null", "_kept", "null", "rest", "tag", "pos", "bits", "key", "probability", "weight", "topic", "n_tokens", "class_id", "first")


@pytest.fixture(scope="module")
def docs(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join(words[(i * 5 + j * (i + 1)) % 12] for j in range(30 + i)) + f" only {i} here", "de", "web") for i in range(12)]
    rows += [(20, rows[3][1], "de", "web"), (21, None, None, None), (None, "no id at all", "en", "book")]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return x.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in OWN])


def unchanged(df, docs, also=("doc_id", "lang", "source")):
    cols = [*also, *OWN]
    assert df.columns == docs.columns
    was = {tuple(r) for r in docs.select(*cols).collect()}
    rows = df.select(*cols).collect()
    assert all(tuple(r) in was for r in rows)
    return len(rows)


def test_distinct(docs):
    assert unchanged(jaccard.distinct(docs), docs) == docs.count() - 1


def test_sampled(docs):
    assert 0 < unchanged(mixing.sampled(docs, budget=0.5), docs) < docs.count()


def test_rows_without_an_id_are_sampled_one_by_one(spark):
    rows = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("lang"), F.lit("b").alias("source"))
    assert 120 < mixing.sampled(rows, budget=0.5).count() < 280


def test_removed(docs):
    got = suffixes.removed(docs)
    assert unchanged(got, docs) == docs.count()
    assert got.where("doc_id = 20").first().text == ""


def test_written(spark, docs, tmp_path):
    sharding.write(docs.where("doc_id is not null"), 2000, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert unchanged(back.select(*docs.columns), docs) == docs.count() - 1 and "shard_" in back.columns


def test_free():
    assert common.free(["a", "A_", "b"], "A", "c", "c") == ["A__", "c", "c_"]
