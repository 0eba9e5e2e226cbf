"""Factor scores: correlated metrics condensed to a quality and a cost score."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tuneline.functions.scalars import correlation, no_nan, transform_time
from tuneline.operators.linalg import moments, moments_frame, read_moments, varimax
from tuneline.session import materialize, require_columns

#: The metrics of an evaluated design.
DEFAULT_METRICS = ["Accuracy_Mean", "Precision_Mean", "Recall_Mean", "Specificity_Mean", "Time_MeanFold"]


def zscore(df: DataFrame, columns: list[str], by: list[str] | None = None, suffix: str = "_z") -> DataFrame:
    """``df`` with z-scores (sample deviation, a zero one counts as 1); null where a group has one row. Null group keys form a group."""
    require_columns(df, *columns, *(by or []))
    held = df.groupBy(*(by or [])).agg(*[f(no_nan(F.col(c))).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    if by:
        right = held.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in held.columns if c not in by])
        on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        joined = df.join(right, on, "left")
    else:
        joined = df.crossJoin(F.broadcast(held))
    z = {f"{c}{suffix}": (no_nan(F.col(c)) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return joined.select(*df.columns, *[e.alias(n) for n, e in z.items()])


@dataclass
class Rotation:
    """What turns z-scored metrics into factor scores: one column of weights a factor, and which factors mean what."""

    metrics: list[str]
    means: np.ndarray
    deviations: np.ndarray
    loadings: np.ndarray
    cost: int | None
    quality: int

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(m, j + 1, float(self.loadings[i, j])) for i, m in enumerate(self.metrics) for j in range(self.loadings.shape[1])], "metric string, factor int, loading double")


def factor_count(k: int | None, p: int, timed: bool, eigenvalues: np.ndarray | None = None) -> int:
    """How many factors: as asked, or by eigenvalues over 1; with a time metric 3 at least; never more than metrics."""
    if eigenvalues is not None:
        k = int((eigenvalues > 1).sum())
    elif k is None:
        return 3 if timed else 2
    return min(max(k, 3 if timed else 1), p)


def principal_components(corr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k strongest unit eigenvectors of a correlation matrix, and all eigenvalues, largest first."""
    values, vectors = np.linalg.eigh(corr)
    return vectors[:, ::-1][:, :k], values[::-1]


def fit_rotation(df: DataFrame, metrics: list[str], time_metric: str | None, k: int | None = 3, automatic: bool = False, rotation: str = "varimax") -> Rotation:
    """Loadings from one pass over ``df``: components, rotated, labelled and signed. Rows with a missing metric are left out."""
    require_columns(df, *metrics)
    means, deviations, corr, _ = moments(df, metrics)
    return rotate(means, deviations, corr, metrics, time_metric, k, automatic, rotation)


def rotate(means: np.ndarray, deviations: np.ndarray, corr: np.ndarray, metrics: list[str], time_metric: str | None, k: int | None, automatic: bool, rotation: str) -> Rotation:
    """Components of a correlation matrix, rotated, labelled and signed."""
    if rotation not in ("varimax", "none"):
        raise ValueError(f"unknown rotation: {rotation}")
    timed = time_metric in metrics
    _, values = principal_components(corr, len(metrics))
    k = factor_count(k, len(metrics), timed, values if automatic else None)
    loadings, _ = principal_components(corr, k)
    if rotation == "varimax" and k > 1:
        loadings = loadings @ varimax(loadings)
    others = [i for i, m in enumerate(metrics) if m != time_metric]
    strength = np.abs(loadings)
    cost = int(strength[metrics.index(time_metric)].argmax()) if timed else None
    quality = int(strength[others].mean(0).argmax())
    for j in range(k):
        sign = np.sign(loadings[metrics.index(time_metric), j] if j == cost else loadings[others, j].mean())
        loadings[:, j] *= sign or 1.0
    return Rotation(metrics, means, np.where(deviations == 0, 1.0, deviations), loadings, cost, quality)


def rotated_scores(found: Rotation) -> list[Column]:
    """The factor scores as column expressions: sums of z-scores times literal weights."""
    z = [(no_nan(F.col(m)) - F.lit(float(a))) / F.lit(float(s)) for m, a, s in zip(found.metrics, found.means, found.deviations, strict=True)]
    return [sum((e * F.lit(float(w)) for e, w in zip(z, found.loadings[:, j], strict=True)), F.lit(0.0)) for j in range(found.loadings.shape[1])]


def pca_project(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """``df`` with PC1 ... PCk, scores of the z-scored columns on unit-norm components (signed so that a component's largest entry is positive)."""
    means, deviations, corr, _ = moments(df, columns)
    loadings, _ = principal_components(corr, k)
    for j in range(k):
        loadings[:, j] *= np.sign(loadings[np.abs(loadings[:, j]).argmax(), j]) or 1.0
    found = Rotation(columns, means, np.where(deviations == 0, 1.0, deviations), loadings, None, 0)
    return df.withColumns({f"PC{j + 1}": e for j, e in enumerate(rotated_scores(found))})


def combine_scores(df: DataFrame, factors: list[str], cost: str | None, quality: str, weights: list[float] | None = None, combine: bool = True) -> DataFrame:
    """``df`` with Score_Quality and Score_Cost.

    Score_Cost is minus the z-score of the time factor, so larger is cheaper (0 without one).
    Score_Quality is the weighted mean of the z-scores of the other factors, if there are three
    factors or more and a time factor; otherwise, and without ``combine``, of the quality factor alone.
    """
    others = [f for f in factors if f != cost] if combine and cost and len(factors) >= 3 else [quality]
    weights = weights or [1.0] * len(others)
    if len(weights) != len(others):
        raise ValueError(f"weights needed: {len(others)}")
    z = zscore(df, factors, suffix="__z")
    low = -F.col(f"{cost}__z") if cost else F.lit(0.0)
    high = sum((F.col(f"{f}__z") * F.lit(float(w)) for f, w in zip(others, weights, strict=True)), F.lit(0.0)) / float(sum(weights))
    return z.withColumns({"Score_Quality": high, "Score_Cost": low}).drop(*[f"{f}__z" for f in factors])


def score_sanity(df: DataFrame, cost: str, time_metric: str, limit: float = -0.30) -> DataFrame:
    """One row: n, corr and warn. The cost score should fall as time grows; with under 3 complete rows there is no verdict."""
    rows = df.select(no_nan(F.col(cost)).alias("c"), no_nan(F.col(time_metric)).alias("t")).dropna()
    checked = rows.agg(F.count(F.lit(1)).alias("n"), correlation(F.col("c"), F.col("t")).alias("r"))
    corr = F.when(F.col("n") >= 3, F.col("r"))
    return checked.select("n", corr.alias("corr"), F.coalesce(corr > limit, F.lit(False)).alias("warn"))


def _complete(df: DataFrame, metrics: list[str], time_metric: str | None, mode: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """``df`` with the transformed time as _time, its complete rows (written once), and the names of the metrics to use."""
    require_columns(df, *metrics)
    held = df.withColumn("_time", transform_time(F.col(time_metric), mode)) if time_metric in metrics else df
    names = ["_time" if m == time_metric else m for m in metrics]
    return held, materialize(held.where(sum((no_nan(F.col(c)).isNull().cast("int") for c in names), F.lit(0)) == 0), "complete"), names


def factor_scores_by(df: DataFrame, by: list[str], metrics: list[str] | None = None, time_metric: str | None = "Time_MeanFold", mode: str = "log1p", k: int | None = 3, automatic: bool = False, rotation: str = "varimax", weights: list[float] | None = None, combine: bool = True, on_missing: str = "drop") -> DataFrame:
    """factor_scores() of each group, for any number of groups: ``df`` with FACTOR<j>_SCORE, Score_Quality and Score_Cost.

    Moments are one aggregate; each group's small matrix is rotated where its row lies, and its
    weights are joined back, so nothing reaches the driver but the largest number of factors and how many groups' cost scores
    hardly fall as time grows, which is warned of. With ``automatic`` each group has its own number of factors, and
    the scores of those that it lacks are null. Null keys form a group; rows with a missing
    metric are dropped, or an error with ``on_missing='error'``, and the scores of a group of one row are null.
    """
    metrics = metrics or DEFAULT_METRICS
    require_columns(df, *by)
    held, complete, names = _complete(df, metrics, time_metric, mode)
    if on_missing == "error" and held.count() != complete.count():
        raise ValueError("rows with missing metrics")
    timed = "_time" in names
    p = len(names)

    def turn(batches):
        for b in batches:
            out = b[by].copy()
            found = [rotate(*read_moments(m, p), names, "_time" if timed else None, k, automatic, rotation) for m in b["moments"]]
            # Weights lie metric by metric in rows of p, so that groups of any number of factors have arrays alike.
            padded = [np.pad(f.loadings, ((0, 0), (0, p - f.loadings.shape[1]))).ravel() for f in found]
            out["_mean"], out["_dev"], out["_load"], out["_k"] = [f.means for f in found], [f.deviations for f in found], padded, [f.loadings.shape[1] for f in found]
            out["_cost"], out["_quality"] = [-1 if f.cost is None else f.cost for f in found], [f.quality for f in found]
            yield out

    keys = StructType([StructField(c, df.schema[c].dataType) for c in by])
    kinds = StructType(keys.fields + StructType.fromDDL("_mean array<double>, _dev array<double>, _load array<double>, _k int, _cost int, _quality int").fields)
    turned = materialize(moments_frame(complete, names, by).mapInPandas(turn, kinds), "rotations")
    most = (turned.agg(F.max("_k")).first()[0] or 1) if automatic else factor_count(k, p, timed)
    right = turned.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[f for f in turned.columns if f not in by])
    joined = complete.join(right, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], "left")
    z = [(no_nan(F.col(m)) - F.get("_mean", F.lit(i))) / F.get("_dev", F.lit(i)) for i, m in enumerate(names)]
    factors = [f"FACTOR{j + 1}_SCORE" for j in range(most)]
    scores = {f: F.when(F.col("_k") > j, sum((e * F.get("_load", F.lit(i * p + j)) for i, e in enumerate(z)), F.lit(0.0))) for j, f in enumerate(factors)}
    held = zscore(joined.select(*complete.columns, "_k", "_cost", "_quality", *[e.alias(f) for f, e in scores.items()]), factors, by, "__z")
    own = F.array(*[F.col(f"{f}__z") for f in factors])
    alone = F.get(own, F.col("_quality"))
    several = combine and timed and most >= 3
    if weights and (automatic or len(weights) != (most - 1 if several else 1)):
        raise ValueError("each group has weights of its own number of factors" if automatic else f"weights needed: {most - 1 if several else 1}")
    if several:
        weights = weights or [1.0] * (most - 1)
        # The cost factor has no weight, and those after it take the weight before their place.
        share = [F.when(F.col("_cost") > j, F.lit(float(weights[min(j, most - 2)]))).when(F.col("_cost") < j, F.lit(float(weights[max(j - 1, 0)]))).otherwise(0.0) for j in range(most)]
        high = sum((F.when(F.col("_k") > j, F.col(f"{f}__z") * w).otherwise(0.0) for j, (f, w) in enumerate(zip(factors, share, strict=True))), F.lit(0.0))
        mean = high / (F.col("_k") - 1) if automatic else high / float(sum(weights))
        high = F.when(F.col("_k") >= 3, mean).otherwise(alone)
    else:
        high = alone
    out = held.withColumns({"Score_Quality": high, "Score_Cost": -F.get(own, F.col("_cost")) if timed else F.lit(0.0)})
    out = materialize(out.drop("_time", "_k", "_cost", "_quality", *[f"{f}__z" for f in factors]), "grouped-scores")
    if timed:
        checked = out.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), correlation(F.col("Score_Cost"), no_nan(F.col(time_metric))).alias("_r"))
        bad = checked.where("_n >= 3 and _r > -0.30").count()
        if bad:
            warnings.warn(f"Score_Cost hardly falls as {time_metric} grows in {bad} groups", stacklevel=2)
    return out


def factor_scores(df: DataFrame, metrics: list[str] | None = None, time_metric: str | None = "Time_MeanFold", mode: str = "log1p", k: int | None = 3, automatic: bool = False, rotation: str = "varimax", weights: list[float] | None = None, combine: bool = True, on_missing: str = "drop") -> tuple[DataFrame, Rotation]:
    """The whole chain: ``df`` with FACTOR<j>_SCORE, Score_Quality and Score_Cost, and the rotation.

    Complete rows are written once; passes over them give the moments, the scores' own, and whether
    the cost score falls as time grows, which is warned of if it doesn't. The rest is one projection.
    Rows with a missing metric are dropped, or an error with ``on_missing='error'``.
    """
    metrics = metrics or DEFAULT_METRICS
    held, complete, names = _complete(df, metrics, time_metric, mode)
    if on_missing == "error" and held.count() != complete.count():
        raise ValueError("rows with missing metrics")
    found = fit_rotation(complete, names, "_time" if time_metric in metrics else None, k, automatic, rotation)
    factors = [f"FACTOR{j + 1}_SCORE" for j in range(found.loadings.shape[1])]
    scored = complete.withColumns(dict(zip(factors, rotated_scores(found), strict=True)))
    cost = None if found.cost is None else factors[found.cost]
    out = combine_scores(scored, factors, cost, factors[found.quality], weights, combine)
    found.metrics = list(metrics)
    if cost:
        seen = score_sanity(out, "Score_Cost", time_metric).first()
        if seen["warn"]:
            warnings.warn(f"Score_Cost hardly falls as {time_metric} grows: correlation {seen['corr']:.3f}", stacklevel=2)
    return out.drop("_time"), found
