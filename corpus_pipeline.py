"""The corpus pipeline: quality, toxicity, near-duplicates, packing; each stage works on all its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame. A stage's result is written as Parquet and read
again before the next one starts, so no stage's lineage holds another's. All but the last return the columns
of docs as they came.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import read_table, written
from weftline.llm.pack import pack
from weftline.llm.quality import quality_filter
from weftline.llm.simhash import keep_one
from weftline.llm.toxicity import toxicity_filter
from weftline.session import ship

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 6) rejects go."""
    ship(spark)
    labels = read_table(spark, sf_dir, "labels")
    return quality_filter(docs, labels)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (operator 8) rejects go."""
    ship(spark)
    labels = read_table(spark, sf_dir, "labels")
    return toxicity_filter(docs, labels)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 3) stays: the one with the smallest id."""
    ship(spark)
    return keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences (operator 5)."""
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenisers are beyond SQL; tests hold run() against a plain recomputation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
