"""A training-corpus pipeline: each stage reads the documents that the one before it kept.

Quality classification, line dedup, near-dedup, mixing to target weights, BPE encoding. Each
stage's output is written to the shared folder, so a lost executor costs one stage's work.

All stages take repeated rows as rows of their own, read texts whole, keep further columns of
any name, and turn an empty table into an empty table; ties go by ids and hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuneline.llm import bpe, line_dedup, mixing, near_dup, quality_classifier
from tuneline.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts score alike, and repeated rows stay or go together."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents left without a line. Null and empty texts stay as they are."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays. Texts without words, and rows without id, are nobody's duplicate."""
    return near_dup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source; a text without words has size 0."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and of what they decode to. A null text counts as an empty one."""
    return bpe.digests(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]
#: Model fits, signatures and tokens aren't SQL; tests hold each stage, and run()'s rows, against brute force on the smallest tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
