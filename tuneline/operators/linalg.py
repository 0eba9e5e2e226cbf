"""Sufficient statistics in one pass, and small-matrix algebra on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneline.functions.scalars import correlation, no_nan
from tuneline.operators.blocks import moment_cells
from tuneline.session import require_columns


#: Columns beyond which products are summed in blocks of rows, not by an aggregate for each pair.
WIDE = 60


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlations of all pairs of columns, in one pass; rows with a missing value in any column are left out.

    Up to WIDE columns that is one aggregate, beyond them sums of blocks. A column that doesn't vary correlates with none.
    """
    require_columns(df, *columns)
    if len(columns) > WIDE:
        return _wide_correlations(df, columns)
    values = df.select(*[no_nan(F.col(c)).alias(c) for c in columns]).dropna()
    places = range(len(columns))
    wide = values.agg(*[correlation(F.col(columns[i]), F.col(columns[j])).alias(f"r{i}_{j}") for i in places for j in places if i <= j])
    cells = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"r{min(i, j)}_{max(i, j)}").alias("r")) for i in places for j in places]
    return wide.select(F.inline(F.array(*cells)))


def _wide_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = moment_cells(df, columns)
    # Cells of the diagonal are no more than the columns, whose names the driver holds too.
    diagonal = cells.where("i = j").select("i", F.col("m2").alias("v"))
    both = cells.join(F.broadcast(diagonal), "i").join(F.broadcast(diagonal.select(F.col("i").alias("j"), F.col("v").alias("u"))), "j")
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("v") > 0, 1.0)).otherwise(F.try_divide("m2", F.sqrt(F.col("v") * F.col("u"))))
    names = F.array(*[F.lit(c) for c in columns])
    each = both.select(F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), r.alias("r"), (F.col("i") < F.col("j")).alias("_twice"))
    mirrored = F.when(F.col("_twice"), F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))).otherwise(F.array(F.struct("a", "b", "r")))
    return each.select(F.inline(mirrored))


def wide_gram(df: DataFrame, columns: list[str] | str, width: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, n, s): the sums of products of all places i <= j of ``columns``, or of one array column of ``width`` numbers.

    For hundreds of columns: tasks add up matrices of blocks of rows, and one array a tile is merged. Rows with a
    missing value in any place are left out.
    """
    cells = moment_cells(df, columns, width, by)
    return cells.select(*(by or []), "i", "j", "n", (F.col("m2") + F.col("n") * F.col("mean_i") * F.col("mean_j")).alias("s"))


def gram_of(df: DataFrame, x: list[Column], y: Column) -> tuple[np.ndarray, int]:
    """The Gram matrix of ``x``, the constant 1 first, and ``y``, on the driver, and the rows; by aggregates up to WIDE columns, else by blocks."""
    p = len(x) + 1
    if p <= WIDE:
        row = gram(df, x, y).first().asDict()
        return gram_matrix(row, p), row["n"]
    held = df.select(F.array(*[c.cast("double") for c in [*x[1:], y]]).alias("_v"))
    means, products, n = _wide_moments(held, "_v", p - 1)
    g = np.empty((p, p))
    g[1:, 1:] = products + n * np.outer(means, means)
    g[0] = g[:, 0] = np.append(n, n * means)
    return g, n


def _wide_moments(df: DataFrame, columns: list[str] | str, width: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, centred products and rows of many columns on the driver, from one pass."""
    width = width or len(columns)
    cells = moment_cells(df, columns, width).toArrow()
    i, j, mean_i, mean_j, m2 = (cells[c].to_numpy() for c in ("i", "j", "mean_i", "mean_j", "m2"))
    means, products = np.zeros(width), np.zeros((width, width))
    means[i], means[j] = mean_i, mean_j
    products[i, j] = products[j, i] = m2
    return means, products, cells["n"][0].as_py() if len(cells) else 0


def moments_frame(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``by``, n and moments, an array: means, sample deviations and correlations of the pairs i < j. Rows with a missing value are left out; one aggregate."""
    values = df.select(*(by or []), *[no_nan(F.col(c)).alias(f"_v{i}") for i, c in enumerate(columns)]).dropna(subset=[f"_v{i}" for i in range(len(columns))])
    names = [f"_v{i}" for i in range(len(columns))]
    sums = [*[F.avg(c) for c in names], *[F.stddev_samp(c) for c in names], *[correlation(F.col(a), F.col(b)) for i, a in enumerate(names) for b in names[i + 1 :]]]
    return values.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("moments"))


def read_moments(held, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and correlation matrix from an array of moments_frame(); what a group is too small for is 0."""
    held = np.nan_to_num(np.array([0.0 if x is None else x for x in held], float))
    upper = np.zeros((p, p))
    upper[np.triu_indices(p, 1)] = held[2 * p :]
    return held[:p], held[p : 2 * p], np.eye(p) + upper + upper.T


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Means, sample deviations, correlation matrix and rows (missing values left out row by row), from one pass."""
    if len(columns) > WIDE:
        means, products, n = _wide_moments(df, columns)
        spread = np.sqrt(np.diag(products))
        corr = np.divide(products, np.outer(spread, spread), out=np.zeros_like(products), where=np.outer(spread, spread) > 0)
        np.fill_diagonal(corr, 1.0)
        return means, spread / np.sqrt(max(n - 1, 1)), corr, n
    row = moments_frame(df, columns).first()
    return *read_moments(row["moments"], len(columns)), row["n"]


def gram(df: DataFrame, x: list[Column], y: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """n and the sums of products s_i_j (i <= j) of ``x``, then ``y`` as the last index; one aggregate, one row a group."""
    cols = [*x, y] if y is not None else list(x)
    held = df.select(*(by or []), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"s_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return held.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *sums)


def gram_matrix(row: dict, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = 0.0 if row[f"s_{i}_{j}"] is None else row[f"s_{i}_{j}"]
    return out


def t_tail(t: float, df: float) -> float:
    """P(abs(T) > t) of Student's distribution, by the continued fraction of the incomplete beta function."""
    if not df > 0 or math.isnan(t):
        return 1.0
    if math.isinf(t):
        return 0.0
    return _beta(df / 2, 0.5, df / (df + t * t))


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    out = 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            num = 1.0
        elif k % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        out *= c * d
        if k and abs(1 - c * d) < 1e-15:
            break
    return min(1.0, front * (out - 1))


@dataclass
class Fit:
    """A least-squares fit: coefficients, p-values, R squared plain and adjusted, rows."""

    coef: np.ndarray
    p: np.ndarray
    r2: float
    r2_adj: float
    n: int


def solve(g: np.ndarray, n: int, on_singular: str = "error") -> Fit:
    """Least squares from a Gram matrix whose first column is the constant and whose last is the response."""
    xx, xy, yy, k = g[:-1, :-1], g[:-1, -1], g[-1, -1], len(g) - 1
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    unit = xx / np.outer(scale, scale)
    if np.linalg.matrix_rank(unit, tol=1e-10 * k, hermitian=True) < k:
        if on_singular != "pinv":
            raise ValueError("the terms are collinear on these rows")
        inverse = np.linalg.pinv(unit, hermitian=True) / np.outer(scale, scale)
    else:
        inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    coef = inverse @ xy
    rss, tss, free = max(0.0, yy - coef @ xy), yy - g[0, -1] ** 2 / n, n - k
    error = np.sqrt(np.maximum(np.diag(inverse) * (rss / free if free > 0 else np.nan), 0))
    p = np.array([t_tail(abs(c) / e if e > 0 else math.inf, free) for c, e in zip(coef, error, strict=True)])
    r2 = 1 - rss / tss if tss > 0 else 0.0
    return Fit(coef, p, r2, 1 - (1 - r2) * (n - 1) / free if free > 0 else math.nan, n)


def ols(df: DataFrame, terms: list[str], factors: list[str], y: str, on_singular: str = "error") -> DataFrame:
    """(term, coef, p_value, r2, r2_adj, n): ordinary least squares with a constant, from one pass over complete rows."""
    from tuneline.functions.scalars import term_expr

    require_columns(df, *factors, y)
    names = ["Intercept", *[t for t in terms if t != "Intercept"]]
    rows = df.select(*[no_nan(F.col(c)).alias(c) for c in dict.fromkeys([*factors, y])]).dropna()
    fit = solve(*gram_of(rows, [term_expr(t, factors) for t in names], F.col(y)), on_singular)
    out = [(t, float(c), float(p), float(fit.r2), float(fit.r2_adj), fit.n) for t, c, p in zip(names, fit.coef, fit.p, strict=True)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, p_value double, r2 double, r2_adj double, n long")


def varimax(loadings: np.ndarray, rounds: int = 100, tolerance: float = 1e-7) -> np.ndarray:
    """The rotation that makes squared loadings vary most."""
    p, k = loadings.shape
    rotation, last = np.eye(k), 0.0
    for _ in range(rounds):
        turned = loadings @ rotation
        target = loadings.T @ (turned**3 - turned * (turned**2).mean(0))
        u, s, v = np.linalg.svd(target)
        rotation = u @ v
        if s.sum() <= last * (1 + tolerance):
            break
        last = s.sum()
    return rotation
