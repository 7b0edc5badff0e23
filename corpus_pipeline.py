"""Documents to packed training sequences, in five stages.

Every stage takes the documents its predecessor kept and returns documents (the last
returns pieces of sequences); each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fm_index, mixing, ngram_join, packing, quality
from tidemark.llm.tables import documents, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the ordinal model, fitted on ``labels``, grades as toxic or poor."""
    ratings = quality.ratings_of(documents(spark, sf_dir, "labels"))
    return quality.selected(docs, quality.fit(docs, ratings, n_grades=3))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word Jaccard similarity of 0.8 or more the least id stays."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every stretch of 35 words that occurs again anywhere."""
    return fm_index.shortened(docs, window=35)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents 0 to 3 times, so that the sources' words meet the target weights."""
    return mixing.repeated(docs, weights=(5, 2, 1), most=3.0)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids of lexical neighbours."""
    return packing.packed(docs, window=2048)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", one_of_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("source_mix", mixed_sources),
    ("packing", packed_sequences),
]

#: A fitted model, a dynamic program and retrieval are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
