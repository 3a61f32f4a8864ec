"""The queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bwt_dedup, langid, line_dedup, minhash, mixing, passages, pieces, ppm, projection, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op2_line_dedup_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"), words=line_dedup.WORDS)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digest(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_folds(_table(spark, sf_dir, "documents"), across=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup_documents(_table(spark, sf_dir, "documents"), minhash.Rule(width=3, percent=85))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_table(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.dedup_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    """Query functions by name, in the order of the operators' numbers."""
    own = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in sorted(own, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""
    return {
        "op2_line_dedup": line_dedup.SQL,
        "op6_minhash_near_dedup": minhash.SQL,
        "op7_exact_topk": topk.SQL,
        "op10_embedding_near_dedup": projection.SQL,
    }
