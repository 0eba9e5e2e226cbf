"""What the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(c, _UPPER, _UPPER.lower())


def count_words(c: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def escape(literal: str) -> str:
    """A literal as a regular expression that Java and RE2 read alike."""
    return re.sub(r"([^\w])", r"\\\1", literal)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has (in any case), for columns that come and go inside an operator."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """Whether a row's label may not be learned from: crc32 of its id as text leaves ``rest``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: dict[int, int], allowed: Column) -> DataFrame:
    """Texts and labels to fit on: for each label at most ``most[label]`` ids, those with the smallest hash, and one row of each.

    The bound makes the sample's ids small enough to broadcast, and the sample small enough
    to collect, whatever the tables' sizes and however often an id repeats in either. Of an
    id's texts the one of the smallest hash counts.
    """
    rows = labels.where(allowed & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_label"))
    picked = None
    for label, n in most.items():
        part = rows.where(F.col("_label") == label).distinct().orderBy(F.xxhash64(F.col("_key").cast("string")), "_key").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_key")
    one = found.groupBy("_key", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), F.col("_text").alias("text"))).alias("_first"))
    return one.select(F.col("_first.text").alias("_text"), "_label", "_key")
