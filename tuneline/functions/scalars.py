"""Scalar building blocks: casts, fills, transforms and polynomial terms as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneline.session import require_columns


@dataclass(frozen=True)
class Factor:
    """A factor's box: bounds, and whether only whole numbers are allowed."""

    lo: float
    hi: float
    is_int: bool = False


#: The seven-factor boosting preset.
BOOSTING = {
    "subsample": Factor(0.05, 1.0),
    "colsample_bytree": Factor(0.05, 1.0),
    "colsample_bylevel": Factor(0.05, 1.0),
    "learning_rate": Factor(0.01, 0.30),
    "max_depth": Factor(3, 18, True),
    "gamma": Factor(0.05, 5.0),
    "n_estimators": Factor(50, 700, True),
}


def no_nan(c: Column) -> Column:
    """NaN and infinities are missing values here, and become null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation as an aggregate over rows without missing values; null where a side doesn't vary, for which Spark's own divides by zero."""
    return F.try_divide(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a)), F.stddev_pop(b))


def cast_factor(c: Column, is_int: bool) -> Column:
    """Whole-number factors round half to even; the others are doubles."""
    return F.bround(c.cast("double")).cast("long") if is_int else c.cast("double")


def cast_factors(df: DataFrame, factors: dict[str, Factor]) -> DataFrame:
    require_columns(df, *factors)
    return df.withColumns({n: cast_factor(F.col(n), f.is_int) for n, f in factors.items()})


def project_factors(df: DataFrame, names: list[str], missing: str = "error") -> DataFrame:
    """The named factors; with ``missing='ignore'`` absent ones are left out."""
    if missing != "ignore":
        require_columns(df, *names)
    return df.select(*[n for n in names if n in df.columns])


def to_number(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what isn't a finite number becomes null."""
    require_columns(df, *columns)
    return df.withColumns({c: no_nan(F.col(c).cast("string").try_cast("double")) for c in columns})


def fill_midpoint(df: DataFrame, factors: dict[str, Factor]) -> DataFrame:
    """A missing factor takes the centre of its box."""
    require_columns(df, *factors)
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit((f.lo + f.hi) / 2)) for n, f in factors.items()})


def transform_time(c: Column, mode: str = "log1p") -> Column:
    """none, log1p (clipped at 0) or log (clipped at 1e-12); non-finite values are missing."""
    d = no_nan(c)
    if mode == "none":
        return d
    if mode == "log1p":
        return F.when(d.isNotNull(), F.log1p(F.greatest(d, F.lit(0.0))))
    if mode == "log":
        return F.when(d.isNotNull(), F.log(F.greatest(d, F.lit(1e-12))))
    raise ValueError(f"unknown time transform: {mode}")


def slug(c: Column) -> Column:
    """A name that is safe in paths: letters, digits, - and _; blanks and dots become _."""
    plain = F.regexp_replace(F.translate(c, " .", "__"), r"[^\p{L}\p{N}_-]", "")
    return F.coalesce(F.nullif(F.regexp_replace(plain, "^_+|_+$", ""), F.lit("")), F.lit("item"))


def normalize_range(c: Column, lo: Column, hi: Column, clip: bool = False) -> Column:
    """(c - lo) / (hi - lo). A vanishing width counts as 1, or gives 0 when clipping to [0, 1]."""
    width = hi - lo
    if clip:
        return F.when(F.abs(width) < 1e-12, 0.0).otherwise(F.least(F.greatest((c - lo) / F.nullif(width, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return (c - lo) / F.when(F.abs(width) < 1e-12, 1.0).otherwise(width)


def distance_to_utopia(quality: Column, cost: Column) -> Column:
    return (1 - quality) * (1 - quality) + (1 - cost) * (1 - cost)


def weighted_score(first: Column, second: Column, b1: Column, b2: Column) -> Column:
    return b1 * first + b2 * second


def in_range(values: list[tuple[Column, Column, Column]]) -> Column:
    """Whether every (value, low, high) holds low <= value <= high."""
    out = F.lit(True)
    for v, lo, hi in values:
        out = out & v.between(lo, hi)
    return out


_CONSTANT = {"intercept", "const", "1"}


def term_expr(term: str, factors: list[str], unknown: str = "error") -> Column:
    """A polynomial term as a column: a constant, ``1/v``, ``v^p`` or a product of such parts.

    Blanks and parentheses are ignored; ``1/v`` is 0 where abs(v) <= 1e-12. A name that isn't
    a factor is an error, or with ``unknown='compat'`` counts as 0 in an inverse or a power
    and as 1 in a product.
    """
    plain = re.sub(r"[\s()]", "", term)
    if plain.lower() in _CONSTANT:
        return F.lit(1.0)

    def value(name: str, otherwise: float) -> Column:
        if name in factors:
            return F.col(name).cast("double")
        if unknown != "compat":
            raise ValueError(f"unknown factor {name!r} in term {term!r}")
        return F.lit(otherwise)

    if plain.startswith("1/"):
        v = value(plain[2:], 0.0)
        return F.when(F.abs(v) <= 1e-12, 0.0).otherwise(1.0 / F.nullif(v, F.lit(0.0)))
    out = None
    for part in plain.split("*"):
        name, power, p = part.partition("^")
        if not name:
            raise ValueError(f"empty part in term {term!r}")
        c = F.pow(value(name, 0.0), F.lit(float(p))) if power else value(name, 1.0)
        out = c if out is None else out * c
    return out


def predict_terms(terms: list[tuple[str, float]], factors: list[str], unknown: str = "error") -> Column:
    """Sum of coefficient times term: one projection."""
    out = F.lit(0.0)
    for term, coef in terms:
        out = out + F.lit(float(coef)) * term_expr(term, factors, unknown)
    return out


def quadratic_terms(factors: list[str]) -> list[str]:
    """Names in order: Intercept, linear, squares, products."""
    pairs = [f"{a}*{b}" for i, a in enumerate(factors) for b in factors[i + 1 :]]
    return ["Intercept", *factors, *(f"{f}*{f}" for f in factors), *pairs]


def quadratic_expand(df: DataFrame, factors: list[str]) -> DataFrame:
    """The quadratic model matrix: one column a term."""
    require_columns(df, *factors)
    return df.select(*[term_expr(t, factors).alias(t) for t in quadratic_terms(factors)])
