"""Search baselines on an equal evaluation budget: grid, random, surrogate-guided and density-guided."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tuneline.functions.scalars import Factor, no_nan
from tuneline.operators.evaluate import Factory, evaluate_candidates, logistic
from tuneline.operators.relational import best_config
from tuneline.operators.sampling import distinct_configs, factor_levels, permuted_grid, random_configs
from tuneline.operators.selection import select_ranks
from tuneline.session import materialize

#: Evaluations of a search that its process is fitted on at most.
HISTORY = 1_000
#: Cells, in kernel widths, and terms of the series by which a cell's rows are summed up.
_CELL, _ORDER = 0.5, 24


def equal_budget(budget: int, design_rows: int, candidates: int) -> int:
    """The budget asked for, or what the main method spends."""
    return budget if budget > 0 else design_rows + candidates


def summary(best: DataFrame, method: str, budget: int, seconds: float) -> DataFrame:
    """The best row with method, budget, Optimization_Time_Seconds and Total_Time_Seconds."""
    return best.select(F.lit(method).alias("method"), *[c for c in best.columns if c != "config_id"], F.lit(budget).alias("budget"), F.lit(seconds).alias("Optimization_Time_Seconds"), (F.lit(seconds) + F.col("Time_MeanFold")).alias("Total_Time_Seconds"))


def grid_configs(spark, factors: dict[str, Factor], budget: int, seed: int) -> DataFrame:
    """A seeded sample of ``budget`` points of the full grid of evenly spaced levels, drawn without making the grid."""
    rows = factor_levels(spark, factors, budget).orderBy("factor", "level_no").collect()
    levels = {n: [r["level"] for r in rows if r["factor"] == n] for n in factors}
    return permuted_grid(spark, levels, budget, seed)


def grid_search(data: DataFrame, factors: dict[str, Factor], budget: int, seed: int = 42, factory: Factory = logistic, k: int = 5) -> DataFrame:
    began = time.perf_counter()
    chosen = materialize(grid_configs(data.sparkSession, factors, budget, seed), "grid")
    best, _ = evaluate_candidates(data, chosen, factors, factory, k)
    # A small grid may have fewer points than the budget.
    return summary(best, "grid", chosen.count(), time.perf_counter() - began)


def random_search(data: DataFrame, factors: dict[str, Factor], budget: int, seed: int = 42, factory: Factory = logistic, k: int = 5) -> DataFrame:
    began = time.perf_counter()
    chosen = materialize(distinct_configs(data.sparkSession, factors, budget, seed), "random")
    best, _ = evaluate_candidates(data, chosen, factors, factory, k)
    # Whole numbers of a small box may have fewer combinations than the budget.
    return summary(best, "random", chosen.count(), time.perf_counter() - began)


def _flat(found: DataFrame, factors: dict[str, Factor]) -> DataFrame:
    return found.select("config_id", "Accuracy_Mean", "Time_MeanFold", *[c for c in found.columns if c.endswith("_Mean") and c != "Accuracy_Mean"], "hyperparameters", *[F.element_at("hyperparameters", F.lit(n)).alias(n) for n in factors])


@dataclass
class Process:
    """A Gaussian process on points of the unit box: what its posterior needs."""

    x: np.ndarray
    weights: np.ndarray
    inverse: np.ndarray
    length: float
    mean: float
    scale: float

    def posterior(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations of the noiseless values at rows of ``at``."""
        k = _kernel(at, self.x, self.length)
        variance = np.maximum(1 - ((k @ self.inverse) * k).sum(1), 0.0)
        return self.mean + self.scale * (k @ self.weights), self.scale * np.sqrt(variance)


def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    apart = ((a[:, None] - b[None]) ** 2).sum(2) if len(a) * len(b) <= 1 << 22 else (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.exp(-np.maximum(apart, 0) / (2 * length**2))


def fit_process(x: np.ndarray, y: np.ndarray, lengths: tuple = (0.1, 0.2, 0.4, 0.8), noises: tuple = (1e-4, 1e-2, 1e-1)) -> Process:
    """The process with a squared exponential kernel, of values less their mean over their deviation; length and noise are those of the largest likelihood."""
    mean, scale = float(y.mean()), float(y.std()) or 1.0
    z, best = (y - mean) / scale, None
    for length in lengths:
        k = _kernel(x, x, length)
        for noise in noises:
            held = k + noise * np.eye(len(x))
            sign, log = np.linalg.slogdet(held)
            weights = np.linalg.solve(held, z)
            likely = -(z @ weights + log) / 2 if sign > 0 else -math.inf
            if best is None or likely > best[0]:
                best = likely, length, weights, np.linalg.inv(held)
    return Process(x, best[2], best[3], best[1], mean, scale)


def expected_improvement(mean: np.ndarray, deviation: np.ndarray, top: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (mean - top) / deviation
    share = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z.tolist()])
    out = (mean - top) * share + deviation * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return np.where(deviation > 0, out, np.maximum(mean - top, 0.0))


def surrogate_scores(history: DataFrame, pool: DataFrame, factors: dict[str, Factor], lengths: tuple = (0.1, 0.2, 0.4, 0.8), noises: tuple = (1e-4, 1e-2, 1e-1)) -> DataFrame:
    """``pool`` (config_id, factors) with the posterior mean and deviation of its accuracy, and the expected improvement over the best so far.

    The history is a search's evaluations, each of which took model fits, and HISTORY of them at most; it is fitted on the
    driver. The pool may have any size and is scored where it lies. Evaluations without an accuracy don't count.
    """
    names = list(factors)
    held = history.select("Accuracy_Mean", *[F.col(f).cast("double").alias(f) for f in names]).where(no_nan(F.col("Accuracy_Mean")).isNotNull()).orderBy(*names, "Accuracy_Mean").limit(HISTORY + 1).toArrow()
    if len(held) > HISTORY:
        raise ValueError(f"a history of over {HISTORY} evaluations")
    if not len(held):
        raise ValueError("no evaluations")
    low, width = np.array([f.lo for f in factors.values()], float), np.array([(f.hi - f.lo) or 1.0 for f in factors.values()], float)
    past, y = np.column_stack([held[f].to_numpy() for f in names]), held["Accuracy_Mean"].to_numpy()
    shared = pool.sparkSession.sparkContext.broadcast((fit_process((past - low) / width, y, lengths, noises), float(y.max())))

    def score(batches):
        process, top = shared.value
        for b in batches:
            x = np.column_stack([b.column(b.num_columns - len(names) + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            found = [process.posterior((x[at : at + 4096] - low) / width) for at in range(0, len(x), 4096)]
            mean, deviation = (np.concatenate([np.zeros(0), *(f[i] for f in found)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names) + 1], pa.array(mean), pa.array(deviation), pa.array(expected_improvement(mean, deviation, top))], ["config_id", *names, "mean", "deviation", "improvement"])

    rows = pool.select("config_id", *names, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(names)])
    kinds = StructType([*pool.select("config_id", *names).schema.fields, *StructType.fromDDL("mean double, deviation double, improvement double").fields])
    return rows.mapInArrow(score, kinds)


def surrogate_pick(history: DataFrame, pool: DataFrame, factors: dict[str, Factor], n: int) -> DataFrame:
    """The ``n`` pool rows of largest expected improvement under a Gaussian process of the history; ties go to smaller ids."""
    return surrogate_scores(history, pool, factors).orderBy(F.desc("improvement"), "config_id").limit(n).select("config_id", *factors)


def _good_from(history: DataFrame, good_share: float) -> Column:
    """Whether a history row's percentile rank by accuracy, best first and ties alike, is at most ``good_share``; nulls rank last.

    The cut is the accuracy of the last row of that rank, which histograms find; one number reaches the driver.
    """
    if not 0 <= good_share <= 1:
        raise ValueError("good_share lies between 0 and 1")
    acc = F.nanvl(F.col("Accuracy_Mean").cast("double"), F.lit(None).cast("double"))
    n, held = history.agg(F.count(F.lit(1)), F.count(acc)).first()
    place = math.floor(good_share * (n - 1)) if n > 1 else 0
    # A product can miss the rank by rounding where the quotient, which is what counts, doesn't.
    place += int(n > 1 and (place + 1) / (n - 1) <= good_share)
    if place >= held:
        return F.lit(True)
    cut = select_ranks(history, [], ["Accuracy_Mean"], F.array(F.lit(held - 1 - place))).first()["value"]
    return F.coalesce(acc >= cut, F.lit(False))


def _moments(history: DataFrame, good: Column, factors: dict[str, Factor]) -> dict[str, tuple[list, list]]:
    """For each factor and the good and other rows: (centre, row count, moments) of the cells that hold values."""
    names, powers = list(factors), range(_ORDER)
    held = F.array(*[F.struct(F.lit(i).alias("f"), (F.col(n).cast("double") / _width(factors[n])).alias("x")) for i, n in enumerate(names)])
    cells = history.select(good.alias("good"), F.explode(held).alias("h")).where(F.col("h.x").isNotNull()).select("good", "h.f", "h.x").withColumn("cell", F.rint(F.col("x") / _CELL))
    t = F.col("x") - F.col("cell") * _CELL
    sums = [F.sum(F.exp(-t * t / 2) * F.pow(t, F.lit(i))).alias(f"m{i}") for i in powers]
    out: dict[str, tuple[list, list]] = {n: ([], []) for n in names}
    for r in sorted(cells.groupBy("f", "good", "cell").agg(F.count("x").alias("n"), *sums).collect(), key=lambda r: r["cell"]):
        out[names[r["f"]]][0 if r["good"] else 1].append((r["cell"] * _CELL, r["n"], [r[f"m{i}"] / math.factorial(i) for i in powers]))
    return out


def _parzen(x: np.ndarray, cells: list) -> np.ndarray:
    """The mean of exp(-(x - h)^2 / 2) over the rows h that the cells' moments sum up; 0 where there are none."""
    total = np.zeros(len(x))
    for centre, _, moments in cells:
        d = x - centre
        total += np.exp(-d * d / 2) * np.polynomial.polynomial.polyval(d, moments)
    return np.nan_to_num(total / max(1, sum(n for _, n, _ in cells)), nan=0.0)


def _width(box: Factor) -> float:
    return max((box.hi - box.lo) / 5, 1e-9)


def density_pick(history: DataFrame, pool: DataFrame, factors: dict[str, Factor], n: int, good_share: float = 0.25) -> DataFrame:
    """The ``n`` pool rows of largest ratio of Parzen densities of good to other history rows, factors taken one by one.

    Both tables may grow: the history is summed up once in moments about the middles of cells
    that are half a kernel's width (the box has eleven), from which densities follow
    to double precision, and the pool passes by them.
    """
    moments = _moments(history, _good_from(history, good_share), factors)
    names = list(factors)
    rows = pool.select("config_id", *names).dropDuplicates()
    held = rows.select("config_id", *names, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(names)])

    def ratios(batches):
        for b in batches:
            total = np.zeros(b.num_rows)
            for i, f in enumerate(names):
                x = b.column(b.num_columns - len(names) + i).to_numpy(zero_copy_only=False).astype(float) / _width(factors[f])
                good, other = (_parzen(x, cells) for cells in moments[f])
                total += np.log(np.maximum(good, 0) + 1e-12) - np.log(np.maximum(other, 0) + 1e-12)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names) + 1], pa.array(total)], ["config_id", *names, "_r"])

    kinds = StructType([*rows.schema.fields, StructField("_r", DoubleType())])
    return held.mapInArrow(ratios, kinds).orderBy(F.desc("_r"), "config_id").limit(n).select("config_id", *names)


def guided_search(data: DataFrame, factors: dict[str, Factor], budget: int, pick: str, seed: int = 42, factory: Factory = logistic, k: int = 5, pool: int = 10_000, batch: int | None = None) -> DataFrame:
    """Random points first, then rounds that pick from a fresh pool by the history; the winner is evaluated again, within the budget."""
    if pick not in ("surrogate", "density"):
        raise ValueError("pick is surrogate or density")
    if budget < 3:
        raise ValueError("a guided search needs a budget of 3")
    began, spark = time.perf_counter(), data.sparkSession
    batch, first = batch or max(1, budget // 4), max(1, budget // 2)
    _, found = evaluate_candidates(data, random_configs(spark, factors, first, seed), factors, factory, k)
    history, spent = materialize(_flat(found, factors), "history"), first
    while spent < budget - 1:
        n = min(batch, budget - 1 - spent)
        fresh = random_configs(spark, factors, pool, seed + spent).withColumn("config_id", F.col("config_id") + 1_000_000 * (spent + 1))
        chosen = surrogate_pick(history, fresh, factors, n) if pick == "surrogate" else density_pick(history, fresh, factors, n)
        _, found = evaluate_candidates(data, materialize(chosen, "chosen"), factors, factory, k)
        history = materialize(history.unionByName(_flat(found, factors)), "history")
        spent += n
    top = best_config(history, "Accuracy_Mean", "config_id").select("config_id", *factors)
    best, _ = evaluate_candidates(data, top, factors, factory, k)
    return summary(best, pick, budget, time.perf_counter() - began)


def surrogate_search(data: DataFrame, factors: dict[str, Factor], budget: int, **more) -> DataFrame:
    return guided_search(data, factors, budget, "surrogate", **more)


def density_search(data: DataFrame, factors: dict[str, Factor], budget: int, **more) -> DataFrame:
    return guided_search(data, factors, budget, "density", **more)
