"""Deterministic samples and factor grids; every draw is a hash, so partitioning can't change it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.functions.scalars import Factor


def shuffle_key(seed: int | Column, key: Column) -> Column:
    """The MD5 of seed and key; null for a null key."""
    head = F.lit(f"{seed}-") if isinstance(seed, int) else F.concat(seed.cast("string"), F.lit("-"))
    return F.md5(F.concat(head, key.cast("string")).cast("binary"))


def level_count(n_factors: int, budget: int) -> int:
    k = math.ceil(budget ** (1 / n_factors) - 1e-12)
    return max(3, k)


def factor_levels(spark: SparkSession, factors: dict[str, Factor], budget: int) -> DataFrame:
    """(factor, level_no, level): evenly spaced levels; whole-number ones rounded half to even, clamped and distinct."""
    k = level_count(len(factors), budget)
    boxes = F.inline(F.array(*[F.struct(F.lit(n).alias("factor"), F.lit(float(f.lo)).alias("lo"), F.lit(float(f.hi)).alias("hi"), F.lit(f.is_int).alias("is_int")) for n, f in factors.items()]))
    grid = spark.range(1).select(boxes).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    raw = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(k - 1))
    level = F.when(F.col("is_int"), F.least(F.greatest(F.bround(raw), F.col("lo")), F.col("hi"))).otherwise(raw)
    rows = grid.withColumn("level", level).groupBy("factor", "level").agg(F.min("i").alias("level_no"))
    return rows.select("factor", "level_no", "level")


def grid_product(spark: SparkSession, levels: dict[str, list[float]]) -> DataFrame:
    """All combinations of levels: config_id from 0 counts them, so the grid needs no join and splits evenly."""
    total = math.prod(map(len, levels.values()))
    out, step = spark.range(total).withColumnRenamed("id", "config_id"), 1
    for name, own in levels.items():
        at = F.expr(f"cast(config_id div {step} % {len(own)} as int)")
        out = out.withColumn(name, F.get(F.array(*[F.lit(v) for v in own]), at))
        step *= len(own)
    return out


#: Rounds of the keyed permutation.
_ROUNDS = 4


def permuted_pairs(spark: SparkSession, a: int, b: int, n: int, seed: int) -> DataFrame:
    """(i, l, r) for i from 0 to n - 1: distinct pairs with l < a and r < b, in the order of a permutation keyed by ``seed``.

    Rounds move one side by a hash of the other, modulo the side's size, and so can be undone; no pair but
    those asked for is looked at.
    """
    if n > a * b:
        raise ValueError("more pairs than there are")
    rows = spark.range(n).select(F.col("id").alias("i"), F.expr(f"id % {a}").alias("l"), F.expr(f"id div {a}").alias("r"))
    for t in range(_ROUNDS):
        other, own, size = ("r", "l", a) if t % 2 == 0 else ("l", "r", b)
        shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-perm-{t}-"), F.col(other).cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
        rows = rows.withColumn(own, F.pmod(F.col(own) + shift, F.lit(size)))
    return rows


def permuted_grid(spark: SparkSession, levels: dict[str, list[float]], n: int, seed: int) -> DataFrame:
    """config_id and the levels of ``n`` distinct points of the grid, a seeded sample without replacement; all points, if there are no more.

    It costs ``n``, not the grid, which may have more points than fit an integer: a point is a pair of places in the
    products of the first and of the last factors. With a single factor its levels are laid out in a near square.
    """
    names = list(levels)
    total = math.prod(map(len, levels.values()))
    if total <= n:
        return grid_product(spark, levels)
    if len(names) == 1:
        a = math.isqrt(total)
        places = permuted_pairs(spark, a, -(-total // a), a * -(-total // a), seed).select(F.col("i").alias("config_id"), (F.col("r") * a + F.col("l")).alias("l")).where(F.col("l") < total).orderBy("config_id").limit(n)
        halves = [("l", names)]
    else:
        halves = [("l", names[: len(names) // 2]), ("r", names[len(names) // 2 :])]
        a, b = (math.prod(len(levels[f]) for f in own) for _, own in halves)
        places = permuted_pairs(spark, a, b, n, seed).withColumnRenamed("i", "config_id")
    out = ["config_id"]
    for side, own in halves:
        step = 1
        for name in own:
            at = F.expr(f"cast({side} div {step} % {len(levels[name])} as int)")
            out.append(F.get(F.array(*[F.lit(float(v)) for v in levels[name]]), at).alias(name))
            step *= len(levels[name])
    return places.select(*out)


def distinct_configs(spark: SparkSession, factors: dict[str, Factor], n: int, seed: int) -> DataFrame:
    """n distinct combinations of drawn values: max(10, n) draws a factor, then a sample of their combinations without replacement.

    Equal draws of a factor are one value, so no two rows are alike; a box of fewer points gives them all.
    """
    draws = max(10, n)
    values = spark.range(draws).orderBy("id").select(*[draw(f, unit_draw(seed, name, F.col("id"))).cast("double").alias(name) for name, f in factors.items()]).collect()
    levels = {name: list(dict.fromkeys(r[name] for r in values)) for name in factors}
    return permuted_grid(spark, levels, n, seed)


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement (all, if there are no more), by a hash of ``key``.

    Counts by the hash's first four digits (65,536 rows) give the one bucket in which the sample
    ends; only its rows are sorted, so that the sample isn't gathered in one task.
    """
    rows = df.withColumn("_h", shuffle_key(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 4))
    left = n
    for b, count in sorted((tuple(r) for r in rows.groupBy("_b").count().collect()), key=lambda r: r[0] or ""):
        if count > left:
            before, inside = ((F.col("_b") < b) | F.col("_b").isNull(), F.col("_b") == b) if b is not None else (F.lit(False), F.col("_b").isNull())
            return rows.where(before).unionByName(rows.where(inside).orderBy("_h", key).limit(left)).drop("_h", "_b")
        left -= count
    return df


def unit_draw(seed: int | Column, name: str, key: Column) -> Column:
    """A uniform number in [0, 1): the first 52 bits of the MD5 of seed, name and key."""
    head = F.lit(f"{seed}-{name}-") if isinstance(seed, int) else F.concat(seed.cast("string"), F.lit(f"-{name}-"))
    text = F.concat(head, key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def draw(f: Factor, u: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """A value of the box, or of the part between ``lo`` and ``hi``; whole numbers include both ends."""
    lo, hi = F.lit(float(f.lo)) if lo is None else lo, F.lit(float(f.hi)) if hi is None else hi
    if f.is_int:
        return F.least(lo + F.floor(u * (hi - lo + 1)), hi).cast("double")
    return lo + u * (hi - lo)


def random_configs(spark: SparkSession, factors: dict[str, Factor], n: int, seed: int) -> DataFrame:
    """n configurations, uniform in their boxes."""
    base = spark.range(n).withColumnRenamed("id", "config_id")
    return base.select("config_id", *[draw(f, unit_draw(seed, name, F.col("config_id"))).alias(name) for name, f in factors.items()])
