"""The pipeline's stages, each on what the one before it kept."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from kilnframe.llm import tokens
from kilnframe.llm.common import saved, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, DIR))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    got = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).toPandas()
    t = tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(t.encode(r.text)) + 1 for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    assert got.groupby("doc_id").length.sum().to_dict() == sizes
