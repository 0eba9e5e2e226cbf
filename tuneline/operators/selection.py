"""Exact order statistics by group without a task that holds a large group.

Doubles become 64-bit keys in the same order. Small groups are sorted, so many a task that its memory doesn't grow with the table. For large ones four
passes count the keys' next sixteen bits among those that agree with a wanted one so far; a histogram has 65,536 rows at most, and counts are summed
up before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tuneline.functions.scalars import no_nan
from tuneline.session import materialize, require_columns

_BITS, _LEVELS = 16, 4
#: Groups or wanted places that a broadcast may hold; more are dealt out and hashed, and the rows they are joined with stream past.
_FEW = 100_000
#: Values of a group and column up to which the group is sorted, and values that a sorting task has of all its groups, some 100 bytes each.
HELD, _PART = 65_536, 1_500_000


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # Adding 0 makes a negative zero a positive one. Keys are ordered as unsigned numbers are.
        x = (b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
        key = np.where(x < 0, ~x, x ^ np.int64(-(2**63)))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(key)], [*b.schema.names[:-1], "_key"])


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
        x = np.where(key < 0, key ^ np.int64(-(2**63)), ~key).view(np.float64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x)], [*b.schema.names[:-1], "value"])


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= _FEW else df.hint("shuffle_hash")


def _by_sorting(rows: DataFrame, n: int, ranks: Column) -> DataFrame:
    """(_g, n, rank, _prefix): whole keys at the wanted ranks of groups that a task may hold; there are ``n`` rows."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / _PART))
    keys = [f"_g.{f.name}" for f in rows.schema["_g"].dataType.fields]
    # Plain columns, whose values sort faster than a structure's. Keys are ordered as unsigned numbers are.
    flat = rows.select(*keys, F.col("_key").bitwiseXOR(F.lit(-(2**63))).alias("_at"))
    own = flat.columns[:-1]
    ordered = Window.partitionBy(*own).orderBy("_at")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # So many parts by number: by size, parts of rows that pack well would be joined into ones that don't fit a sort.
    placed = flat.repartition(parts, *own).withColumns({"n": F.count(F.lit(1)).over(whole), "rank": F.row_number().over(ordered).cast("long") - 1})
    found = placed.where(F.array_contains(ranks.cast("array<long>"), F.col("rank")))
    return found.select(F.struct(*own).alias("_g"), "n", "rank", F.col("_at").bitwiseXOR(F.lit(-(2**63))).alias("_prefix"))


def _by_histograms(rows: DataFrame, counts: DataFrame, ranks: Column) -> DataFrame:
    """(_g, n, rank, _prefix): whole keys at the wanted ranks of the groups of ``counts`` (_g, n)."""
    wanted = counts.withColumn("rank", F.explode(F.array_distinct(ranks.cast("array<long>")))).where("rank >= 0 and rank < n")
    wanted = materialize(wanted.select("_g", "n", "rank", F.col("rank").alias("_left"), F.lit(0).cast("long").alias("_prefix")), "wanted")
    for level in range(_LEVELS):
        shift = 64 - _BITS * (level + 1)
        prefix = F.lit(0).cast("long") if level == 0 else F.shiftrightunsigned("_key", shift + _BITS)
        digit = F.shiftrightunsigned("_key", shift).bitwiseAND(F.lit((1 << _BITS) - 1)).alias("_digit")
        places = _few(wanted.select("_g", "_prefix").distinct(), wanted.limit(_FEW + 1).count())
        found = rows.select("_g", prefix.alias("_prefix"), digit).join(places, ["_g", "_prefix"], "left_semi")
        histogram = found.groupBy("_g", "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_g", "_prefix").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        histogram = histogram.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        inside = (F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_n"))
        wanted = wanted.join(histogram, ["_g", "_prefix"]).where(inside)
        wanted = materialize(wanted.select("_g", "n", "rank", (F.col("_left") - F.col("_before")).alias("_left"), F.shiftleft("_prefix", _BITS).bitwiseOR(F.col("_digit")).alias("_prefix")), "wanted")
    return wanted.drop("_left")


def select_ranks(df: DataFrame, by: list[str], columns: list[str], ranks: Column, held: int = HELD) -> DataFrame:
    """(by, column, n, rank, value): of each group and column the value of each rank, from 0 in ascending order.

    ``ranks`` is an array column of whole numbers over ``n``, the group's number of values; missing ones don't count, a rank that isn't there gives
    no row, and null keys form a group. Groups of up to ``held`` values of a column are dealt out once and sorted; larger ones take four passes
    over one written table of keys, whatever their sizes.
    """
    require_columns(df, *by, *columns)
    held_by = [f"_by{i}" for i in range(len(by))]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), no_nan(F.col(c)).alias("_x")) for c in columns]))
    long = df.select(*[F.col(c).alias(h) for c, h in zip(by, held_by, strict=True)], each.alias("_e")).select(*held_by, "_e.column", "_e._x").where("_x is not null")
    kinds = StructType([*long.schema.fields[:-1], StructField("_key", LongType())])
    # Keys of a group may be null, so a structure stands for them.
    rows = materialize(long.mapInArrow(_keyed, kinds).select(F.struct(*held_by, "column").alias("_g"), "_key"), "keys")
    n, groups, inside = rows.count(), 0, 0
    if n > held:
        large = materialize(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held), "large")
        groups, inside = large.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not groups:
        found = _by_sorting(rows, n, ranks)
    else:
        found = _by_histograms(rows, large, ranks)
        if inside < n:
            others = rows.join(_few(large.select("_g"), groups), "_g", "left_anti")
            found = found.unionByName(_by_sorting(others, n - inside, ranks))
    out = found.select(*[F.col(f"_g.{h}").alias(c) for h, c in zip(held_by, by, strict=True)], "_g.column", "n", "rank", F.col("_prefix").alias("_key"))
    kinds = StructType([*out.schema.fields[:-1], *StructType.fromDDL("value double").fields])
    return out.mapInArrow(_valued, kinds)


def medians(df: DataFrame, by: list[str], columns: list[str], held: int = HELD) -> DataFrame:
    """(by, column, n, median): the exact median, the mean of the two middle values of an even number."""
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    found = select_ranks(df, by, columns, F.array(low, high), held)
    return found.groupBy(*by, "column", "n").agg(((F.min("value") + F.max("value")) / 2).alias("median"))
