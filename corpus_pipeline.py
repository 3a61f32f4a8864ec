"""A training-data pipeline over documents, made of five of the corpus operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph_spark.llm import langid, line_dedup, minhash, mixing, pieces
from codegraph_spark.llm.shared import saved

#: No stage after language identification is expressible in SQL as a whole; tests compare run() with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or of no language learned, go."""
    return langid.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted from the texts; documents of which nothing is left go."""
    done = line_dedup.dedup_lines(docs, words=line_dedup.WORDS)
    return done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    marked = minhash.dedup_documents(docs, minhash.Rule(width=5, percent=80))
    gone = saved(marked.where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and of those taken in part as much, as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, and whether decoding them gives the texts back."""
    back = pieces.encode(docs, back="decoded")
    return back.select("doc_id", "source", "ids", pieces.same_text().alias("round_trip"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
