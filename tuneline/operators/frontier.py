"""Trade-off candidates: for every pair of weights the best point of the box under two surfaces, for any number of groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.functions.scalars import Factor, cast_factor, in_range, normalize_range, predict_terms, quadratic_terms, term_expr
from tuneline.operators.blocks import matrix
from tuneline.operators.sampling import draw, unit_draw
from tuneline.operators.surface import Surface
from tuneline.session import materialize, require_columns

#: Sweeps of the polish, and the gain of a sweep below which a point rests.
SWEEPS, GAIN = 200, 1e-13
#: A group's columns beside its keys: coefficients of both surfaces in the order of quadratic_terms, and the range of predictions.
_HELD = ["_seed", "_quality", "_cost", "_nadir_1", "_utopia_1", "_nadir_2", "_utopia_2"]


def beta_pairs(step: float) -> list[tuple[float, float]]:
    """Weights (1 - b, b) for b = step, 2 step, ... up to 1, rounded to two decimals; (1, 0) isn't among them."""
    if not 0.01 <= step <= 1:
        raise ValueError("the step lies between 0.01 and 1")
    n = int(1 / step + 1e-9)
    return [(round(1 - i * step, 2), round(i * step, 2)) for i in range(1, n + 1)]


def coefficients(surface: Surface, factors: list[str]) -> list[float]:
    """A surface's coefficients in the order of quadratic_terms, 0 for terms that it lacks; other terms are an error."""
    names = quadratic_terms(factors)
    at = {t: i for i, t in enumerate(names)} | {"*".join(reversed(t.split("*"))): i for i, t in enumerate(names)} | {f"{f}^2": names.index(f"{f}*{f}") for f in factors}
    out = [0.0] * len(names)
    for term, c in surface.pairs():
        if term not in at:
            raise ValueError(f"not a quadratic term: {term}")
        out[at[term]] += float(c)
    return out


def predict_array(coef: Column, factors: list[str]) -> Column:
    """A quadratic polynomial whose coefficients are an array column in the order of quadratic_terms."""
    return sum((F.get(coef, F.lit(i)) * term_expr(t, factors) for i, t in enumerate(quadratic_terms(factors))), F.lit(0.0))


def _quadratics(coef: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Constants, gradients at 0 and symmetric curvatures of rows of coefficients in the order of quadratic_terms."""
    names = [str(i) for i in range(n)]
    g, h = np.zeros((len(coef), n)), np.zeros((len(coef), n, n))
    for k, t in enumerate(quadratic_terms(names)):
        parts = [int(x) for x in t.split("*")] if t != "Intercept" else []
        if len(parts) == 1:
            g[:, parts[0]] = coef[:, k]
        elif parts:
            h[:, parts[0], parts[1]] += coef[:, k]
            h[:, parts[1], parts[0]] += coef[:, k]
    return coef[:, 0], g, h


def _roots(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Both roots of a t^2 + b t + c, by the form that doesn't cancel; what isn't a number where there are none."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        q = -(b + np.where(b < 0, -1.0, 1.0) * np.sqrt(b * b - 4 * a * c)) / 2
        return [q / a, c / q]


def polish(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, quadratics: list[tuple], beta: np.ndarray, ranges: list[tuple] | None, keep: bool) -> np.ndarray:
    """Points of the box, each moved by exact line searches while that helps.

    The weighted sum and both predictions are quadratics along any line, so a line's best allowed point is an end, a
    vertex or a place where a prediction meets its range. Lines are the axes, and the way of the last sweep.
    A point that isn't allowed stays where it is, and no point gets worse.
    """
    x = x.copy()
    n, width = x.shape
    low, high = ([r[0] for r in ranges], [r[1] for r in ranges]) if ranges else ([None] * 2, [None] * 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = [beta[:, i] / (high[i] - low[i]) if ranges else beta[:, i] for i in range(2)]
    live = np.ones(n, bool)

    def along(d: np.ndarray) -> None:
        """Move each live point to the best place of its line."""
        nonlocal x
        p = []
        for c, g, h in quadratics:
            hx, hd = np.einsum("nij,nj->ni", h, x), np.einsum("nij,nj->ni", h, d)
            p.append((c + ((g + hx / 2) * x).sum(1), ((g + hx) * d).sum(1), (hd * d).sum(1) / 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            to_lo, to_hi = (lo - x) / d, (hi - x) / d
            first = np.where(d != 0, np.minimum(to_lo, to_hi), -np.inf).max(1)
            last = np.where(d != 0, np.maximum(to_lo, to_hi), np.inf).min(1)
            slope, bend = (sum(s * q[k] for s, q in zip(scale, p, strict=True)) for k in (1, 2))
            tries = [first, last, -slope / (2 * bend)]
            if ranges and keep:
                for i, q in enumerate(p):
                    for edge in (low[i], high[i]):
                        tries += _roots(q[2], q[1], q[0] - edge)
                # A root may lie outside by its rounding: a hair nearer is tried too.
                tries += [t * (1 - 1e-12) for t in tries[3:]]
        t = np.stack([np.zeros(n), *tries], 1)
        t = np.where(np.isfinite(t) & (t >= first[:, None]) & (t <= last[:, None]), t, 0.0)
        gain, allowed = np.zeros(t.shape), np.ones(t.shape, bool)
        for s, q, a, b in zip(scale, p, low, high, strict=True):
            gain += s[:, None] * (q[1][:, None] * t + q[2][:, None] * t * t)
            if ranges and keep:
                value = q[0][:, None] + q[1][:, None] * t + q[2][:, None] * t * t
                allowed &= (value >= a[:, None]) & (value <= b[:, None])
        gain = np.where(allowed & np.isfinite(gain), gain, -np.inf)
        best = gain.argmax(1)
        step = np.where(live & allowed[:, 0] & (gain[np.arange(n), best] > 0), t[np.arange(n), best], 0.0)
        x = np.clip(x + step[:, None] * d, lo, hi)

    for _ in range(SWEEPS):
        before = x.copy()
        for j in range(width):
            d = np.zeros((n, width))
            d[:, j] = hi[j] - lo[j]
            along(d)
        moved = x - before
        live = np.abs(moved / (hi - lo)).max(1) > GAIN
        if not live.any():
            break
        along(moved)
    return x


def frontier_search_by(groups: DataFrame, by: list[str], factors: dict[str, Factor], step: float = 0.02, starts: int = 30, samples: int = 200, rounds: int = 12, shrink: float = 0.7, seed: int = 42, keep_in_range: bool = True, design: DataFrame | None = None, polished: bool = True, predictions: tuple[Column, Column] | None = None) -> DataFrame:
    """frontier_search() of every group, in as many jobs as of one: keys, then its columns.

    ``groups`` has a row for each group: its keys, ``quality`` and ``cost`` (arrays of coefficients in the order of
    quadratic_terms), and optionally nadir_1, utopia_1, nadir_2, utopia_2 and its own ``seed``. Incumbents are keyed by (keys, pair, start). ``design``
    has the keys and the factors; its rows are starts of their group. Groups of a null key take none. ``predictions`` replace
    both polynomials by columns over the factors, which aren't polished.
    """
    require_columns(groups, *by, "quality", "cost")
    names, ranged = list(factors), "utopia_1" in groups.columns
    own = F.col("seed").cast("long") if "seed" in groups.columns else F.lit(seed).cast("long")
    ends = [F.col(c).cast("double") if ranged else F.lit(None).cast("double") for c in ("nadir_1", "utopia_1", "nadir_2", "utopia_2")]
    held_by = [f"_by{i}" for i in range(len(by))]
    fixed = groups.select(*[F.col(c).alias(h) for c, h in zip(by, held_by, strict=True)], own.alias("_seed"), F.col("quality").alias("_quality"), F.col("cost").alias("_cost"), *[e.alias(c) for e, c in zip(ends, _HELD[3:], strict=True)])
    columns = [*held_by, *_HELD, "pair", "beta_1", "beta_2", "start", *names, "p1", "p2", "ok", "v"]

    first, second = predictions or (predict_array(F.col("_quality"), names), predict_array(F.col("_cost"), names))

    def scored(df: DataFrame) -> DataFrame:
        df = df.withColumns({"p1": first, "p2": second})
        if ranged:
            v1, v2 = (normalize_range(F.col(f"p{i}"), F.col(f"_nadir_{i}"), F.col(f"_utopia_{i}")) for i in (1, 2))
        else:
            v1, v2 = F.col("p1"), F.col("p2")
        ok = in_range([(F.col(f"p{i}"), F.col(f"_nadir_{i}"), F.col(f"_utopia_{i}")) for i in (1, 2)]) if ranged and keep_in_range else F.lit(True)
        return df.withColumns({"ok": ok, "v": F.when(ok, F.col("beta_1") * v1 + F.col("beta_2") * v2)}).select(*columns)

    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("beta_1"), F.lit(b).alias("beta_2")) for i, (a, b) in enumerate(beta_pairs(step))]))
    begun = fixed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(starts - 1).cast("long"))))
    begun = begun.select(*held_by, *_HELD, "start", *[F.when(F.col("start") == 0, F.lit((f.lo + f.hi) / 2)).otherwise(draw(f, unit_draw(F.col("_seed"), n, F.col("start")))).cast("double").alias(n) for n, f in factors.items()])
    if design is not None:
        rows = design.select(*[F.col(c).alias(h) for c, h in zip(by, held_by, strict=True)], (F.pmod(F.xxhash64(*names), F.lit(1 << 40)) + starts).alias("start"), *[F.col(n).cast("double").alias(n) for n in names]).distinct()
        # Without keys there is one row of coefficients to join.
        both = fixed.join(rows, held_by) if by else rows.crossJoin(F.broadcast(fixed))
        begun = begun.unionByName(both.select(*begun.columns))
    held = materialize(scored(begun.withColumn("_pair", pairs).select("*", "_pair.*")), "frontier")
    at = [*held_by, "pair", "start"]
    worth = F.coalesce("v", F.lit(float("-inf")))
    for turn in range(rounds):
        reach = shrink**turn / 2
        key = F.concat_ws("-", "start", "n")
        tried = held.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(samples))))
        moved = {}
        for n, f in factors.items():
            lo, hi = F.greatest(F.lit(float(f.lo)), F.col(n) - (f.hi - f.lo) * reach), F.least(F.lit(float(f.hi)), F.col(n) + (f.hi - f.lo) * reach)
            moved[n] = lo + unit_draw(F.col("_seed") + 1000 * (turn + 1), n, key) * (hi - lo)
        new = scored(tried.select(*held_by, *_HELD, "pair", "beta_1", "beta_2", "start", *[e.alias(n) for n, e in moved.items()]))
        best = held.unionByName(new).groupBy(*at).agg(F.max_by(F.struct(*columns), worth).alias("r"))
        held = materialize(best.select("r.*"), "frontier")
    if polished and predictions is None:
        held = materialize(_polished(held, columns, factors, ranged, keep_in_range, scored).groupBy(*at).agg(F.max_by(F.struct(*columns), worth).alias("r")).select("r.*"), "frontier")
    best = held.groupBy(*held_by, "pair").agg(F.max_by(F.struct(*columns), F.struct(worth, -F.col("start"))).alias("r")).select("r.*")
    whole = best.withColumns({f"_{n}": cast_factor(F.col(n), f.is_int).cast("double") for n, f in factors.items()})
    rounded = whole.withColumns({n: F.col(f"_{n}") for n in names}).withColumns({"_r1": first, "_r2": second})
    success = F.col("v").isNotNull()
    return rounded.select(
        *[F.col(h).alias(c) for c, h in zip(by, held_by, strict=True)],
        "beta_1", "beta_2", F.col("v").alias("score"), F.col("p1").alias("Pred_Score_Quality"), F.col("p2").alias("Pred_Score_Cost"),
        F.col("_r1").alias("Rounded_Score_Quality"), F.col("_r2").alias("Rounded_Score_Cost"),
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"_{n}"))]).alias("hyperparameters"), success.alias("success"),
        F.when(success, "ok").otherwise("no start in the predicted range").alias("message"),
    )


def _polished(held: DataFrame, columns: list[str], factors: dict[str, Factor], ranged: bool, keep: bool, scored) -> DataFrame:
    """``held`` and beside each allowed point the polished one, scored like all others."""
    names, width = list(factors), len(quadratic_terms(list(factors)))
    lo, hi = (np.array([float(getattr(f, e)) for f in factors.values()]) for e in ("lo", "hi"))
    where = {c: i for i, c in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = lambda c: b.column(where[c]).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            x = np.column_stack([number(n) for n in names])
            quadratics = [_quadratics(matrix(b.column(where[c]), width), len(names)) for c in ("_quality", "_cost")]
            ranges = [(number(f"_nadir_{i}"), number(f"_utopia_{i}")) for i in (1, 2)] if ranged else None
            new = polish(x, lo, hi, quadratics, np.column_stack([number("beta_1"), number("beta_2")]), ranges, keep)
            arrays = [pa.array(new[:, names.index(c)]) if c in names else b.column(i) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    allowed = held.where("v is not null").select(*columns)
    return held.select(*columns).unionByName(scored(allowed.mapInArrow(run, allowed.schema)))


def frontier_search(spark: SparkSession, quality: Surface, cost: Surface, factors: dict[str, Factor], step: float = 0.02, starts: int = 30, samples: int = 200, rounds: int = 12, shrink: float = 0.7, seed: int = 42, utopia: tuple[float, float] | None = None, nadir: tuple[float, float] | None = None, keep_in_range: bool = True, design: DataFrame | None = None, polished: bool = True) -> DataFrame:
    """One row a weight pair: beta_1, beta_2, score, predictions at the optimum and at rounded factors, hyperparameters, success, message.

    With ``utopia`` and ``nadir`` predictions are scaled by them and, unless ``keep_in_range`` is
    false, have to lie between them. A weighted sum: parts of the front that aren't convex can't be reached. Incumbents keyed by
    (pair, start) sample a box around them that shrinks each round, and keep the best point; at last exact line searches
    polish them, unless ``polished`` is false. Starts are the centre, uniform points and, where given, the design's rows. Each round is
    written to the shared folder, which cuts its lineage.
    """
    names = list(factors)
    ends = (nadir[0], utopia[0], nadir[1], utopia[1]) if utopia is not None and nadir is not None else ()
    kinds = "quality array<double>, cost array<double>" + "".join(f", {c} double" for c in ("nadir_1", "utopia_1", "nadir_2", "utopia_2")[: len(ends)])
    predictions, arrays = None, ([], [])
    try:
        arrays = coefficients(quality, names), coefficients(cost, names)
    except ValueError:
        # Inverses and higher powers are no quadratics.
        predictions = predict_terms(quality.pairs(), names), predict_terms(cost.pairs(), names)
    one = spark.createDataFrame([(*arrays, *map(float, ends))], kinds)
    return frontier_search_by(one, [], factors, step, starts, samples, rounds, shrink, seed, keep_in_range, design, polished, predictions)
