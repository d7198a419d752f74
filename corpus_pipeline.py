"""Cleaning a document corpus: quality rules, near-duplicates, benchmark leaks, secrets, then packing for training.

Each stage is a function of (spark, docs, sf_dir) that works on all its predecessor kept and gives a table; the next one
reads that table. Tables go to the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import contamination, packing, quality, secrets, simhash, tokens
from clickloom.plans.workspace import staged


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the present text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without failing lines; documents that the rules reject go. A null text is rejected."""
    return _counted(quality.clean_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id; documents without an id stay."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, literally or with other values, go."""
    return contamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret is replaced by a mark. A null text stays null."""
    return _counted(secrets.redact_secrets(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    vocabulary = tokens.public_vocabulary("word_bpe_49k.json", end_id=1, spaces_count=False)
    return packing.packing_digest(packing.pack(packing.pieces(docs, vocabulary, capacity=4096), capacity=4096))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

# Fingerprints, templates, decoded keys and tokens are beyond SQL; the tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
