"""The corpus pipeline: toxicity, language ID, near-duplicates, mixing, packing.

Each stage takes all that its predecessor kept and returns the columns of documents; the
last returns the packed pieces.  SQL cannot express the stages (fitted models, sketches,
random rounding), so they are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import language_id, minhash_dedup, mixing, packing, toxicity
from paperloom.llm.common import Scratch, collected, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents scored 0.5 or more go."""
    small_batches(spark)
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without a letter, or whose language the machines tell hardly better than chance, go."""
    small_batches(spark)
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group the document with the smallest id stays."""
    small_batches(spark)
    return minhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as its source's target asks."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the pieces of the packed sequences."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces.  A stage's scratch tables, and its input, go once its output is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with collected() as used:
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        for s in used:
            s.drop()
        if before:
            scratch.drop(before)
        before = name
    return docs
