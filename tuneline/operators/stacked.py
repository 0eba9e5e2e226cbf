"""Models of all configurations, folds and partitions into folds, fitted together: passes over the data don't grow with their number.

A pass evaluates every model on every block of rows and adds up one array a model. Logistic models take Newton
steps on their sums (loss, gradient, curvature), with elastic-net penalties solved on the driver's
small quadratics; Gaussian naive Bayes needs one pass for each fold's moments, whatever its
configurations. One more pass counts all models' hits on their held-out folds.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneline.operators.blocks import ROWS, matrix, summed

#: Bytes of all models' sums in one pass; more models are fitted in further passes.
SUMS = 128 << 20
#: Newton stops when no coefficient moves by more than this, in deviations of its variable; halvings of a step that doesn't help.
STILL, HALVINGS = 1e-9, 30


@dataclass
class Scale:
    """Over all rows means and deviations of the variables; over the complement of each fold of each partition rows and deviations."""

    mean: np.ndarray
    deviation: np.ndarray
    fold_n: np.ndarray
    fold_deviation: np.ndarray


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(variables, label, folds) of blocks of ROWS rows; folds have a column for each partition."""
    for b in batches:
        y, folds, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1), matrix(b.column(2), width)
        fold = folds.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) if pa.types.is_list(folds.type) else folds.to_numpy(zero_copy_only=False)[:, None]
        for at in range(0, len(y), ROWS):
            yield x[at : at + ROWS], y[at : at + ROWS].astype(float), fold[at : at + ROWS]


def _width(data: DataFrame) -> int:
    row = data.select(F.size("values").alias("p")).first()
    if row is None:
        raise ValueError("no rows")
    return row["p"]


def _collected(df: DataFrame) -> dict[int, np.ndarray]:
    found = df.toArrow()
    return {t: s.values.to_numpy(zero_copy_only=False) for t, s in zip(found["tile"].to_pylist(), found["sums"], strict=True)}


def fold_moments(data: DataFrame, width: int, k: int) -> dict[int, np.ndarray]:
    """For each 2 * (partition * k + fold) + label: rows, means and sums of squared deviations of the variables; one pass."""

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not a[0] or not b[0]:
            return b if not a[0] else a
        n, delta = a[0] + b[0], b[1 : 1 + width] - a[1 : 1 + width]
        return np.concatenate([[n], a[1 : 1 + width] + delta * (b[0] / n), a[1 + width :] + b[1 + width :] + delta**2 * (a[0] * b[0] / n)])

    def sums(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray] = {}
        for x, y, folds in _batches(batches, width):
            for part in range(folds.shape[1]):
                code = 2 * (part * k + folds[:, part]) + (y == 1)
                for c in np.unique(code).tolist():
                    own = x[code == c]
                    mean = own.mean(0)
                    s = np.concatenate([[len(own)], mean, ((own - mean) ** 2).sum(0)])
                    held[c] = merge(held[c], s) if c in held else s
        for c, s in sorted(held.items()):
            yield (c,), s

    return _collected(summed(data.select("label", "fold", "values"), sums, merge))


def _joined(parts: list[np.ndarray], width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and squared deviations of several groups' as one."""
    n = sum(p[0] for p in parts)
    if not n:
        return 0.0, np.zeros(width), np.zeros(width)
    mean = sum(p[0] * p[1 : 1 + width] for p in parts) / n
    return n, mean, sum(p[1 + width :] + p[0] * (p[1 : 1 + width] - mean) ** 2 for p in parts)


def _rest(moments: dict[int, np.ndarray], part: int, fold: int, width: int, k: int, label: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and squared deviations of a partition's rows outside a fold, of one label or of both."""
    return _joined([m for c, m in moments.items() if c // 2 // k == part and c // 2 % k != fold and label in (None, c % 2)], width)


def scale_of(moments: dict[int, np.ndarray], width: int, k: int, parts: int) -> Scale:
    dev = lambda n, ss: np.sqrt(ss / max(n - 1, 1))
    n, mean, ss = _rest(moments, 0, -1, width, k)
    rest = [[_rest(moments, s, f, width, k) for f in range(k)] for s in range(parts)]
    return Scale(mean, np.where(dev(n, ss) > 0, dev(n, ss), 1.0), np.array([[r[0] for r in own] for own in rest]), np.array([[dev(r[0], r[2]) for r in own] for own in rest]))


def _newton_sums(data: DataFrame, width: int, scale: Scale, weights: np.ndarray, part: np.ndarray, held: np.ndarray) -> dict[int, np.ndarray]:
    """For each model its summed loss, gradient and packed curvature over the rows outside its held fold: one pass."""
    q = width + 1
    packed = q * (q + 1) // 2
    shared = data.sparkSession.sparkContext.broadcast((scale.mean, scale.deviation, weights, part, held))

    def sums(batches: Iterator[pa.RecordBatch]):
        mean, deviation, w, own, out = shared.value
        total = np.zeros((len(out), 1 + q + packed))
        seen = False
        for x, y, fold in _batches(batches, width):
            seen = True
            z = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
            learn = (fold[:, own] != out[None]).astype(float)
            margin = z @ w.T
            p = (1 + np.tanh(margin / 2)) / 2
            total[:, 0] += ((np.logaddexp(0, margin) - y[:, None] * margin) * learn).sum(0)
            total[:, 1 : 1 + q] += ((p - y[:, None]) * learn).T @ z
            # A row of the packed curvatures at a time: products of all pairs of variables at once are 35 MB a copy for 64 of them.
            bend, at = (p * (1 - p) * learn).T, 1 + q
            for j in range(q):
                total[:, at : at + q - j] += bend @ (z[:, j : j + 1] * z[:, j:])
                at += q - j
        if seen:
            for m, s in enumerate(total):
                yield (m,), s

    try:
        return _collected(summed(data.select("label", "fold", "values"), sums))
    finally:
        shared.destroy()


def _quadratic_step(w: np.ndarray, g: np.ndarray, h: np.ndarray, lasso: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The minimum of the local quadratic plus the penalties; without a lasso share by solving, else by coordinate descent."""
    h = h + np.diag(np.maximum(1e-12, 1e-12 * np.diag(h)))
    if not lasso.any():
        return np.linalg.solve(h + np.diag(ridge), h @ w - g)
    new, slope = w.copy(), g.copy()
    for _ in range(2_000):
        moved = 0.0
        for j in range(len(w)):
            raw = h[j, j] * new[j] - slope[j]
            best = np.sign(raw) * max(abs(raw) - lasso[j], 0.0) / (h[j, j] + ridge[j])
            step = best - new[j]
            if step:
                slope += h[:, j] * step
                new[j], moved = best, max(moved, abs(step))
        if moved < STILL / 100:
            break
    return new


@dataclass
class Fits:
    """Coefficients in the variables' own units (the constant first) of each (configuration, held fold), the steps that they took, and all passes."""

    models: list[tuple[int, int]]
    coef: np.ndarray
    steps: np.ndarray
    passes: int


def fit_logistic(data: DataFrame, configs: list[dict], k: int, parts: list[int] | None = None) -> Fits:
    """Penalised logistic models of every configuration and held fold.

    A model minimises the mean loss plus regParam times the elastic net of its coefficients, each times its variable's
    deviation in the model's rows; the constant isn't penalised. maxIter bounds its Newton steps.
    A step that makes the objective worse is halved. A pass advances all models that still move; ``data`` has label (0 or 1), values and
    fold, which is a number or an array of one for each partition; ``parts`` gives each configuration's partition.
    """
    width, parts = _width(data), parts or [0] * len(configs)
    scale = scale_of(fold_moments(data, width, k), width, k, max(parts) + 1)
    models = [(c, f) for c in range(len(configs)) for f in range(k)]
    q = width + 1
    most = max(1, SUMS // (8 * (1 + q + q * (q + 1) // 2)))
    coef, steps, passes = np.zeros((len(models), q)), np.zeros(len(models), int), 1
    for at in range(0, len(models), most):
        own = range(at, min(len(models), at + most))
        w, before = {m: np.zeros(q) for m in own}, {}
        halved, left = dict.fromkeys(own, 0), list(own)
        while left:
            part, held = np.array([parts[models[m][0]] for m in left]), np.array([models[m][1] for m in left])
            found = _newton_sums(data, width, scale, np.array([w[m] for m in left]), part, held)
            passes += 1
            still = []
            for i, m in enumerate(left):
                c, f = models[m]
                config, n, deviation = configs[c], scale.fold_n[parts[c], f], scale.fold_deviation[parts[c], f]
                if i not in found or not n:
                    continue
                s = found[i] / n
                reg, share = float(config.get("regParam", 0.0)), float(config.get("elasticNetParam", 0.0))
                relative = np.append(0.0, deviation / scale.deviation)
                lasso, ridge = reg * share * relative, reg * (1 - share) * relative**2
                value = s[0] + lasso @ np.abs(w[m]) + (ridge @ w[m] ** 2) / 2
                if m in before and value > before[m][1] + 1e-12 * abs(before[m][1]):
                    old, _ = before[m]
                    if halved[m] >= HALVINGS:
                        w[m] = old
                        continue
                    halved[m] += 1
                    w[m] = (w[m] + old) / 2
                    still.append(m)
                    continue
                if steps[m] >= int(config.get("maxIter", 20)):
                    continue
                h = np.zeros((q, q))
                h[np.triu_indices(q)] = s[1 + q :]
                h += np.triu(h, 1).T
                # A variable that doesn't vary in the model's rows has no coefficient.
                fixed = np.flatnonzero(np.append(1.0, deviation) == 0)
                h[fixed], h[:, fixed] = 0.0, 0.0
                h[fixed, fixed], slope = 1.0, s[1 : 1 + q].copy()
                slope[fixed] = 0.0
                new = _quadratic_step(w[m], slope, h, lasso, ridge)
                steps[m] += 1
                moved = np.abs(new - w[m]).max()
                before[m], w[m], halved[m] = (w[m], value), new, 0
                if moved > STILL:
                    still.append(m)
            left = still
        for m in own:
            slopes = w[m][1:] / scale.deviation
            coef[m] = np.append(w[m][0] - slopes @ scale.mean, slopes)
    return Fits(models, coef, steps, passes)


def _counts(data: DataFrame, width: int, parts: list[int], k: int, shared, margins) -> np.ndarray:
    """For each configuration and fold, how many rows have (label, prediction) 00, 01, 10, 11 on the held fold: one pass.

    ``margins(held value, configurations, fold, variables)`` gives rows times configurations; positive means class 1.
    """
    own = [(part, [c for c, p in enumerate(parts) if p == part]) for part in sorted(set(parts))]

    def sums(batches: Iterator[pa.RecordBatch]):
        held = shared.value
        total = np.zeros((len(parts), k, 4))
        for x, y, folds in _batches(batches, width):
            for part, configs in own:
                for f in np.unique(folds[:, part]).tolist():
                    at = folds[:, part] == f
                    code = 2 * (y[at] == 1)[:, None] + (margins(held, configs, f, x[at]) > 0)
                    for c in range(4):
                        total[configs, f, c] += (code == c).sum(0)
        yield (0,), total.ravel()

    found = _collected(summed(data.select("label", "fold", "values"), sums)).get(0, np.zeros(len(parts) * k * 4))
    shared.destroy()
    return found.reshape(len(parts), k, 4)


#: Confusion cells (configuration's place, fold, y, pred, n), and (configuration's place, fold, seconds).
Cells = tuple[list[tuple], list[tuple]]


def _cells(counts: np.ndarray, seconds: np.ndarray) -> Cells:
    places = [(c, f) for c in range(counts.shape[0]) for f in range(counts.shape[1])]
    return [(c, f, code // 2, code % 2, int(n)) for c, f in places for code, n in enumerate(counts[c, f]) if n], [(c, f, float(seconds[c, f])) for c, f in places]


def logistic_cells(data: DataFrame, configs: list[dict], k: int, parts: list[int] | None = None) -> Cells:
    """Hits and seconds of logistic models. Seconds are those of the shared passes, dealt out by the steps that a model took."""
    began, parts = time.perf_counter(), parts or [0] * len(configs)
    fits, width = fit_logistic(data, configs, k, parts), _width(data)
    shared = data.sparkSession.sparkContext.broadcast(fits.coef.reshape(len(configs), k, -1))
    counts = _counts(data, width, parts, k, shared, lambda w, own, f, x: x @ w[own, f, 1:].T + w[own, f, 0])
    weight = (fits.steps + 1.0).reshape(len(configs), k)
    return _cells(counts, (time.perf_counter() - began) * weight / weight.sum())


def bayes_cells(data: DataFrame, configs: list[dict], k: int, parts: list[int] | None = None) -> Cells:
    """The same of Gaussian naive Bayes: class 1 where its probability is above a configuration's threshold.

    Variances are widened by a billionth of the largest one in the model's rows. All models take an equal share of the seconds.
    """
    began, width, parts = time.perf_counter(), _width(data), parts or [0] * len(configs)
    moments = fold_moments(data, width, k)
    terms: dict[int, list] = {}
    for part in set(parts):
        terms[part] = []
        for f in range(k):
            n, _, ss = _rest(moments, part, f, width, k)
            least = 1e-9 * (ss / n).max(initial=0.0) if n else 0.0
            both = [_rest(moments, part, f, width, k, y) for y in (0, 1)]
            terms[part].append([(np.log(c / n) if c else -np.inf, mean, own / max(c, 1) + least) for c, mean, own in both])
    cut = np.array([float(c.get("threshold", 0.5)) for c in configs])
    with np.errstate(divide="ignore"):
        cut = np.log(cut / (1 - cut))
    shared = data.sparkSession.sparkContext.broadcast((terms, cut, parts))

    def margins(held, own: list[int], f: int, x: np.ndarray) -> np.ndarray:
        terms, cuts, parts = held
        with np.errstate(divide="ignore", invalid="ignore"):
            raw = [prior - (((x - mean) ** 2) / var + np.log(var)).sum(1) / 2 for prior, mean, var in terms[parts[own[0]]][f]]
        return (raw[1] - raw[0])[:, None] - cuts[own][None]

    counts = _counts(data, width, parts, k, shared, margins)
    return _cells(counts, np.full(counts.shape[:2], (time.perf_counter() - began) / (len(configs) * k)))


def logistic_coefficients(data: DataFrame, configs: list[dict], k: int) -> DataFrame:
    """(config_id, fold, term, coef) of the models that cv_evaluate() fits; term 0 is the constant, then the variables in order."""
    fits = fit_logistic(data, configs, k)
    rows = [(configs[c]["config_id"], f, j, float(w)) for (c, f), own in zip(fits.models, fits.coef, strict=True) for j, w in enumerate(own)]
    return data.sparkSession.createDataFrame(rows, "config_id long, fold int, term int, coef double")
