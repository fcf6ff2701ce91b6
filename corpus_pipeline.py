"""Corpus pipeline: quality rules, SimHash near-dedup, mixing, encoding.

``run`` applies the stages to ``documents``, each to all that the one before
kept, written as Parquet in the shared folder and reread in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderwell.llm import mixing, pieces, quality, simhash
from cinderwell.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision verdict rejects go."""
    return quality.filter_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each remaining document and the text they decode to, with
    its source and language."""
    return pieces.recoded(docs, keep=("source", "lang"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: fingerprints and piece ids have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
