"""Quadratic response surfaces with backward elimination under hierarchy, from one Gram matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tuneline.functions.scalars import no_nan, quadratic_terms, term_expr
from tuneline.operators.linalg import Fit, gram, gram_matrix, gram_of, solve
from tuneline.session import materialize, require_columns


@dataclass
class Surface:
    """A fitted surface in the factors' own units."""

    response: str
    terms: list[str]
    coef: list[float]
    r2: float
    r2_adj: float
    alpha: float
    n: int

    def pairs(self) -> list[tuple[str, float]]:
        return list(zip(self.terms, self.coef, strict=True))


def _removable(term: str, terms: list[str]) -> bool:
    """Squares and products always are; a linear term only once no product or square holds it; the constant never is."""
    if term == "Intercept":
        return False
    return "*" in term or not any(term in t.split("*") for t in terms if "*" in t)


def eliminate(g: np.ndarray, n: int, terms: list[str], alpha: float, on_singular: str = "error") -> tuple[list[str], Fit]:
    """Drop the removable term of the largest p over ``alpha`` (ties: the earliest) until none is left; each step solves a block of ``g``."""
    left = list(range(len(terms)))
    while True:
        fit = solve(g[np.ix_([*left, len(terms)], [*left, len(terms)])], n, on_singular)
        names = [terms[i] for i in left]
        p = [(q if q == q else 1.0) for q in fit.p]
        out = [i for i, t in enumerate(names) if p[i] > alpha and _removable(t, names)]
        if not out or len(left) == 1:
            return names, fit
        left.pop(max(out, key=lambda i: (p[i], -i)))


def _uncode(terms: list[str], coef: np.ndarray, centre: dict[str, float], half: dict[str, float]) -> dict[str, float]:
    """Coefficients in the factors' units of a polynomial in (v - centre) / half."""
    out: dict[str, float] = {}

    def add(t: str, c: float) -> None:
        out[t] = out.get(t, 0.0) + c

    for t, c in zip(terms, coef, strict=True):
        if t == "Intercept":
            add(t, c)
        elif "*" not in t:
            add(t, c / half[t])
            add("Intercept", -c * centre[t] / half[t])
        else:
            a, b = t.split("*")
            s = c / (half[a] * half[b])
            add(t, s)
            add(a, -s * centre[b])
            add(b, -s * centre[a])
            add("Intercept", s * centre[a] * centre[b])
    return out


def _fitted(g: np.ndarray, n: int, terms: list[str], y: str, alpha: float, on_singular: str, centre: dict[str, float], half: dict[str, float]) -> Surface:
    names, fit = eliminate(g, n, terms, alpha, on_singular)
    real = _uncode(names, fit.coef, centre, half)
    held = [t for t in terms if t in real]
    return Surface(y, held, [real[t] for t in held], float(fit.r2), float(fit.r2_adj), alpha, n)


def fit_surface(df: DataFrame, factors: list[str], y: str, alpha: float = 0.05, on_singular: str = "error") -> Surface:
    """The surface of all rows: a pass for the box that codes the factors to [-1, 1], and one for the Gram matrix.

    Coding keeps the matrix well conditioned and changes neither the path of elimination nor the
    fit. Rows with a missing factor or response are left out. One row reaches the driver.
    """
    require_columns(df, *factors, y)
    rows = df.select(*[no_nan(F.col(c)).alias(c) for c in dict.fromkeys([*factors, y])]).dropna()
    box = rows.agg(*[f(c).alias(f"{n}_{c}") for c in factors for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if any(box[f"lo_{c}"] is None for c in factors):
        raise ValueError("no complete rows")
    centre = {c: (box[f"lo_{c}"] + box[f"hi_{c}"]) / 2 for c in factors}
    half = {c: (box[f"hi_{c}"] - box[f"lo_{c}"]) / 2 or 1.0 for c in factors}
    coded = rows.select(F.col(y).alias("_y"), *[((F.col(c) - F.lit(centre[c])) / F.lit(half[c])).alias(c) for c in factors])
    terms = quadratic_terms(factors)
    return _fitted(*gram_of(coded, [term_expr(t, factors) for t in terms], F.col("_y")), terms, y, alpha, on_singular, centre, half)


def surfaces_by(df: DataFrame, factors: list[str], y: str, by: list[str], alpha: float = 0.05, on_singular: str = "error") -> DataFrame:
    """(keys, response, term, coef, r2, r2_adj, alpha, n_terms, n): one surface a group, for any number of groups.

    Each group's factors are coded by its own box. Sums of products are one aggregate, and terms
    are eliminated where a group's row of sums lies, so nothing reaches the driver and a hot group
    is summed up before it is shuffled. Rows with a missing factor, response or key are left out;
    a group whose terms are collinear is an error unless ``on_singular`` is 'pinv'.
    """
    require_columns(df, *factors, y, *by)
    values = list(dict.fromkeys([*factors, y]))
    rows = df.select(*by, *[no_nan(F.col(c)).alias(c) for c in values]).dropna()
    ends = rows.groupBy(*by).agg(*[((F.max(c) + F.min(c)) / 2).alias(f"_centre_{i}") for i, c in enumerate(factors)], *[((F.max(c) - F.min(c)) / 2).alias(f"_half_{i}") for i, c in enumerate(factors)])
    boxes = ends.withColumns({f"_half_{i}": F.when(F.col(f"_half_{i}") == 0, 1.0).otherwise(F.col(f"_half_{i}")) for i in range(len(factors))})
    box = [f"_{n}_{i}" for n in ("centre", "half") for i in range(len(factors))]
    # No key is null here, so the join can be left to Spark: a broadcast if the boxes are few, else a sort-merge with skew handling.
    # Written boxes have a size that Spark knows beforehand; otherwise it deals all rows out by the keys before it sees that they are few.
    held = rows.join(materialize(boxes, "boxes"), by).select(*by, *box, F.col(y).alias("_y"), *[((F.col(c) - F.col(f"_centre_{i}")) / F.col(f"_half_{i}")).alias(c) for i, c in enumerate(factors)])
    terms = quadratic_terms(factors)
    sums = gram(held, [term_expr(t, factors) for t in terms], F.col("_y"), [*by, *box])
    keys = [df.schema[c] for c in by]
    numbers = {"response": "string", "term": "string", "coef": "double", "r2": "double", "r2_adj": "double", "alpha": "double", "n_terms": "int", "n": "long"}

    def fit(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                centre, half = ({c: r[f"_{n}_{i}"] for i, c in enumerate(factors)} for n in ("centre", "half"))
                s = _fitted(gram_matrix(r, len(terms) + 1), int(r["n"]), terms, y, alpha, on_singular, centre, half)
                out += [(*[r[c] for c in by], y, t, float(c), s.r2, s.r2_adj, alpha, len(s.terms), s.n) for t, c in s.pairs()]
            yield pd.DataFrame(out, columns=[*by, *numbers])

    kinds = StructType([StructField(k.name, k.dataType) for k in keys] + StructType.fromDDL(", ".join(f"{n} {t}" for n, t in numbers.items())).fields)
    return sums.mapInPandas(fit, kinds)


def coefficient_arrays(fits: DataFrame, factors: list[str], by: list[str], name: str) -> DataFrame:
    """(by, name) from the rows of surfaces_by(): each group's coefficients as one array in the order of quadratic_terms."""
    held = fits.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("term", "coef"))).alias("_held"))
    return held.select(*by, F.array(*[F.coalesce(F.element_at("_held", F.lit(t)), F.lit(0.0)) for t in quadratic_terms(factors)]).alias(name))


def read_surface(rows: list) -> Surface:
    """A Surface from the collected rows of one group of surfaces_by()."""
    r = rows[0]
    return Surface(r["response"], [x["term"] for x in rows], [x["coef"] for x in rows], r["r2"], r["r2_adj"], r["alpha"], r["n"])
