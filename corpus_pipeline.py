"""Corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup, decontamination, packing.

Each stage takes the rows its predecessor kept. All but the last return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kveil.llm import inverted_index, jaccard_join, packing, quality_rules, suffix_dedup
from kveil.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

NGRAM, PERCENT = 5, 80
VOCABULARY, END_ID = "byte_bpe_50k.json", 0
BATCH_BYTES = 1 << 21  # text encoded at once


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to 80 % or more."""
    return jaccard_join.keep_one(docs, NGRAM, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that also stand in a document with a smaller id."""
    return suffix_dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return inverted_index.keep_clean(docs, items, shared_dir(spark, "inverted-index"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    import public_tokenizers

    cut = packing.pieces(docs, public_tokenizers.path(VOCABULARY), END_ID, leading_space=True, batch_bytes=BATCH_BYTES)
    return packing.pack(cut)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]
ORACLE_SQL = None  # suffix sorting and packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            folder = shared_dir(spark, f"pipeline-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
