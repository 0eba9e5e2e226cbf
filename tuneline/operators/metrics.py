"""Classification metrics and per-method statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneline.functions.scalars import no_nan
from tuneline.operators.relational import group_max
from tuneline.operators.selection import HELD, medians
from tuneline.session import materialize, require_columns

METRICS = ("accuracy", "precision", "recall", "specificity")
STATISTICS = ("mean", "std", "median", "min", "max", "count")


def confusion_metrics(df: DataFrame, by: list[str], label: str = "y", predicted: str = "pred", weight: str | None = None) -> DataFrame:
    """accuracy, precision, recall and specificity of class 1 by group; 0 where a denominator is 0. ``weight`` counts a row so many times."""
    require_columns(df, *by, label, predicted)
    y, p = F.col(label) == 1, F.col(predicted) == 1
    times = F.lit(1) if weight is None else F.col(weight)
    count = lambda hit: F.coalesce(F.sum(F.when(hit, times)), F.lit(0))
    counts = df.groupBy(*by).agg(count(y & p).alias("tp"), count(~y & p).alias("fp"), count(~y & ~p).alias("tn"), count(y & ~p).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return counts.select(*by, ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"))


def fold_means(df: DataFrame, by: list[str], seconds: str | None = None) -> DataFrame:
    """Unweighted means over folds: Accuracy_Mean ... and Time_MeanFold where seconds are given."""
    out = [F.avg(m).alias(f"{m.capitalize()}_Mean") for m in METRICS]
    return df.groupBy(*by).agg(*out, *([F.avg(seconds).alias("Time_MeanFold")] if seconds else []))


#: Values of a group and column up to which a task may hold them for the exact median.
HELD_VALUES = 1_000_000


def method_stats(df: DataFrame, by: str, columns: list[str], approximate: bool = False, held: int = HELD_VALUES) -> DataFrame:
    """Mean, sample deviation, median, extremes and count of non-missing values, for the columns there are; a null group stays.

    Where a group has more than ``held`` values of a column, the exact medians of all groups come from ``selection``, where
    those of large groups come from histograms and not from a task that holds their values; ``approximate`` takes a sketch.
    """
    require_columns(df, by)
    own, aggregates, values = [c for c in columns if c in df.columns], [], {}
    for c in own:
        v = values[c] = no_nan(F.col(c))
        parts = dict(zip(STATISTICS, (F.avg(v), F.stddev_samp(v), F.percentile_approx(v, 0.5, 10_000).cast("double"), F.min(v), F.max(v), F.count(v)), strict=True))
        aggregates += [parts[s].alias(f"{c}_{s}") for s in STATISTICS if approximate or s != "median"]
    stats = df.groupBy(by).agg(*aggregates) if aggregates else df.select(by).distinct()
    if approximate or not own:
        return stats
    stats = materialize(stats, "statistics")
    most = max(stats.agg(*[F.max(f"{c}_count") for c in own]).first(), key=lambda n: n or 0) or 0
    if most <= held:
        right = df.groupBy(F.col(by).alias("_by")).agg(*[F.median(values[c]).alias(f"{c}_median") for c in own])
    else:
        found = medians(df, [by], own, min(held, HELD))
        right = found.groupBy(F.col(by).alias("_by")).agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"{c}_median") for c in own])
    joined = stats.join(right, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.select(by, *[f"{c}_{s}" for c in own for s in STATISTICS])


def win_rate(df: DataFrame, by: str, group: str, metric: str, tolerance: float = 1e-12) -> DataFrame:
    """Wins, rows and win rate by method: a row wins within ``tolerance`` of its group's best; the divisor is the number of groups."""
    require_columns(df, by, group, metric)
    value = no_nan(F.col(metric))
    top = group_max(df, group, metric, "_top")
    wins = top.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(F.coalesce((value >= F.col("_top") - tolerance).cast("long"), F.lit(0))).alias("wins"), F.count(F.lit(1)).alias("n"))
    total = df.agg(F.countDistinct(group).alias("_groups"))
    return wins.crossJoin(F.broadcast(total)).select(by, "wins", "n", F.try_divide(F.col("wins").cast("double"), F.col("_groups")).alias("win_rate"))


def pareto_rate(front: DataFrame, by: str, group: str) -> DataFrame:
    """How often a method is on the front, over the number of groups."""
    total = front.agg(F.countDistinct(group).alias("_groups"))
    counts = front.where("is_pareto").where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("pareto_count"))
    return counts.crossJoin(F.broadcast(total)).select(by, "pareto_count", F.try_divide(F.col("pareto_count").cast("double"), F.col("_groups")).alias("pareto_rate"))


def extremes(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Utopia (max) and nadir (min) of each column; all are to be maximised."""
    out = [f(no_nan(F.col(c))).alias(f"{c}_{n}") for c in columns for n, f in (("utopia", F.max), ("nadir", F.min))]
    return df.groupBy(*(by or [])).agg(*out)
