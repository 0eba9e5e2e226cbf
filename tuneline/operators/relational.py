"""Joins, windows, set operations and ranks of the analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneline.functions.scalars import no_nan
from tuneline.operators.sampling import shuffle_key
from tuneline.operators.skyline import skyline
from tuneline.session import materialize, require_columns


def attach_scores(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    return df.join(scores, on=key, how="left")


def pareto_front(df: DataFrame, by: list[str], maximize: str | list[str], minimize: str | list[str], drop_missing: bool = False) -> DataFrame:
    """``df`` with is_pareto: no row of the group is at least as good in every objective and better in one.

    A row with a missing value never dominates and is kept (or not, with ``drop_missing``).
    Rows with a missing group key go. One objective each way is skyline_2d's; other numbers of them take
    skyline() of the groups' distinct points.
    """
    high, low = ([c] if isinstance(c, str) else list(c) for c in (maximize, minimize))
    if len(high) == len(low) == 1:
        return skyline_2d(df, by, high[0], low[0], drop_missing)
    require_columns(df, *by, *high, *low)
    both = lambda conditions: reduce(lambda a, b: a & b, conditions, F.lit(True))
    values = {f"_o{i}": no_nan(F.col(c)) * (1 if i < len(high) else -1) for i, c in enumerate([*high, *low])}
    rows = df.where(both([F.col(c).isNotNull() for c in by])).withColumns(values)
    whole = both([F.col(c).isNotNull() for c in values])
    front = materialize(skyline(rows.where(whole).select(*by, *values).distinct(), by, list(values)), "front").withColumn("_on", F.lit(True))
    return rows.join(front, [*by, *values], "left").withColumn("is_pareto", F.coalesce("_on", ~whole & F.lit(not drop_missing))).drop(*values, "_on")


def skyline_2d(df: DataFrame, by: list[str], maximize: str, minimize: str, drop_missing: bool = False, salts: int = 16) -> DataFrame:
    """pareto_front for two objectives in n log n: running maxima over the ordered distinct points.

    Equal points collapse first. Each group's points then meet in ``salts`` parts whose own
    fronts are taken; only their survivors meet in one window, so a giant group doesn't.
    """
    require_columns(df, *by, maximize, minimize)
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])).withColumns({"_a": no_nan(F.col(maximize)), "_t": no_nan(F.col(minimize))})
    best = rows.where(F.col("_a").isNotNull() & F.col("_t").isNotNull()).groupBy(*by, "_t").agg(F.max("_a").alias("_a"))

    def front(points: DataFrame, keys: list[str]) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
        top = F.max("_a").over(before)
        return points.withColumn("_top", top).where(F.col("_top").isNull() | (F.col("_top") < F.col("_a"))).drop("_top")

    parts = front(best.withColumn("_salt", F.pmod(F.xxhash64("_t"), F.lit(salts))), [*by, "_salt"]).drop("_salt")
    on = front(parts, by).withColumn("_on", F.lit(True))
    missing = F.col("_a").isNull() | F.col("_t").isNull()
    return rows.join(on, [*by, "_a", "_t"], "left").withColumn("is_pareto", F.coalesce("_on", missing & F.lit(not drop_missing))).drop("_a", "_t", "_on")


def best_config(df: DataFrame, metric: str, seq: str) -> DataFrame:
    """The row of the largest metric; of ties the first by ``seq``. A missing metric never wins."""
    require_columns(df, metric, seq)
    rows = df.withColumn("_m", no_nan(F.col(metric))).where(F.col("_m").isNotNull())
    return rows.agg(F.max_by(F.struct(*df.columns), F.struct("_m", -F.col(seq))).alias("r")).where("r is not null").select("r.*")


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.countDistinct(column)
    return df.agg(count.alias("n"))


def group_max(df: DataFrame, by: str, column: str, out: str = "group_max") -> DataFrame:
    """The group's maximum beside each row; null for rows without a group."""
    top = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.max(no_nan(F.col(column))).alias(out))
    return df.join(top, by, "left")


def first_by(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by ``seq``."""
    require_columns(df, *keys, seq)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")


def dedup_configs(df: DataFrame, factors: list[str], seq: str) -> DataFrame:
    """Distinct on the factor columns, the first kept."""
    return first_by(df, factors, seq)


def running_totals(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in ``order`` (distinct values), in two levels.

    Rows are dealt out by ranges of ``order`` and written; each part's total, one row a part, reaches the
    driver, and the rest of the sum is a window within the part.
    """
    parts = materialize(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals, before = [], 0
    for part, total in sorted(tuple(r) for r in parts.groupBy("_part").agg(F.sum(value)).collect()):
        totals.append((part, before))
        before += total
    ahead = df.sparkSession.createDataFrame(totals, "_part int, _before long")
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    # As many rows as parts.
    return parts.join(F.broadcast(ahead), "_part").withColumn(out, F.col("_before") + F.coalesce(own, F.lit(0))).drop("_part", "_before")


def _folds(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """``rows`` (by, _label as a structure, _key, _h) with fold: the rank by (label, hash, key) of its ``by``, modulo k.

    A rank is that in a bucket of the hash (its first four digits, so 65,536 of them), plus the rows of the class's buckets before, plus those of the classes before.
    No window holds a class, however large, and none holds all classes, however many.
    """
    rows = rows.withColumns({"_h": F.coalesce("_h", F.lit("")), "_b": F.coalesce(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), F.lit(0))})
    counts = materialize(rows.groupBy(*by, "_label", "_b").agg(F.count(F.lit(1)).alias("_n")), "fold-counts")
    within = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Every partition into folds has the same classes: those of the first one stand for all.
    first = counts.where(" and ".join(f"{c} = 0" for c in by)) if by else counts
    classes = running_totals(first.groupBy("_label").agg(F.sum("_n").alias("_rows")), "_label", "_rows", "_class").select("_label", "_class")
    base = counts.withColumn("_within", within).join(classes, "_label").select(*by, "_label", "_b", (F.col("_within") + F.col("_class")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*by, "_label", "_b").orderBy("_h", "_key")) - 1
    # Spark broadcasts the bases if they are few, and otherwise joins where the ranks were counted.
    joined = rows.withColumn("_rank", rank).join(base, [*by, "_label", "_b"])
    return joined.withColumn("fold", F.pmod(F.col("_rank") + F.col("_base"), F.lit(k)).cast("int")).drop("_h", "_b", "_rank", "_base")


def assign_folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """``df`` with a stratified fold from 0; class counts of folds differ by 1 at most, and so do fold sizes.

    A row's rank in its class is by a hash of (seed, key); null labels are a class.
    """
    require_columns(df, label, key)
    # A structure is never null, so one equality serves windows and joins.
    rows = df.withColumns({"_label": F.struct(F.col(label).alias("of")), "_key": F.col(key), "_h": shuffle_key(seed, F.col(key))})
    return _folds(rows, [], k).select(*df.columns, "fold")


def assign_folds_many(df: DataFrame, label: str, key: str, k: int, seeds: list[int]) -> DataFrame:
    """(key, folds): for each of ``seeds``, in order, the fold that assign_folds() gives, in as many jobs as for one. ``key`` is unique."""
    require_columns(df, label, key)
    each = F.posexplode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("_i", "_seed")
    rows = df.select(F.struct(F.col(label).alias("of")).alias("_label"), F.col(key).alias("_key"), each).withColumn("_h", shuffle_key(F.col("_seed"), F.col("_key"))).drop("_seed")
    held = _folds(rows, ["_i"], k).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_i", "fold"))).alias("_f"))
    return held.select(F.col("_key").alias(key), F.col("_f.fold").alias("folds"))


def top_k_by_distance(df: DataFrame, distance: Column, seq: str, k: int) -> DataFrame:
    """The k rows nearest to utopia, ties by ``seq``; k <= 0 means all rows."""
    return df if k <= 0 else df.withColumn("_d", distance).orderBy(F.asc_nulls_last("_d"), seq).limit(k).drop("_d")


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
