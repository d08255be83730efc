"""The corpus pipeline: documents to packed training sequences, each stage on all that the one before kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. Stages are written as Parquet and read again in between.

Defined results: a document without text (null or empty) has the weight 0 for the classifier, is linked with nothing, has nothing to
cut, and is not mixed, since it has no words; null ids are documents like others, null sources a source; of
repeated rows near-duplicates keep one that has words; ties follow the operators' own orders, so reruns agree; very long texts go through
whole; an empty table gives no rows of the last stage's columns; further columns of documents go along to the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import mixing, near_duplicates, packing, quality_classifier, substrings
from quarrylight.tables import made, made_since, remove, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance-resampling classifier: documents that it rejects go."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SetSketch near-duplicates: one document of each group stays."""
    return near_duplicates.dedup(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Seed and extend: passages that repeat are cut."""
    return substrings.cut(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weighted fair queueing: each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shortest-pack-first packing: a row for each piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near),
    ("substring_dedup", substring),
    ("source_mix", mixture),
    ("packing", packed),
]

#: Hashed models and sketches can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = table(spark, sf_dir, "documents"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            done = made_since(others)  # what this run has written so far: the next table replaces it
            docs = written(docs, f"pipeline-{name}")
            remove(done)
    return docs
