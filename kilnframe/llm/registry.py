"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annular, crosspolytope, jaccard, lattice, licences, mixing, packing, prefixcounts, pst, repair, sharding, suffixes, toxicity
from .common import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.query(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.query(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.query(table(spark, sf_dir, "embeddings"))


def op8_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.query(table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.query(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixcounts.query(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.query(table(spark, sf_dir, "conversations"))


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annular.query(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_mixing, op3_sharding, op4_cross_polytope, op5_packing, op6_suffix_dedup, op7_lattice_dedup, op8_suffix_tree_score, op9_licence_scan, op10_toxicity, op11_prefix_counts, op12_conversation_repair, op13_annular_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": jaccard.sql(), "op2_mixing": mixing.sql(), "op3_sharding": sharding.sql(), "op12_conversation_repair": repair.sql(), "op13_annular_codes": annular.sql()}
