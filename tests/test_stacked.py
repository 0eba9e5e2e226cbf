"""Array sums of blocks, wide Gram matrices, and models fitted in shared passes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tuneline.operators import blocks, evaluate, linalg, stacked
from tuneline.operators.factors import pca_project


def _frame(spark, x, extra=None):
    rows = [(i, *((extra[i],) if extra is not None else ()), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"id long, {'g string, ' if extra is not None else ''}v array<double>").repartition(5, "id")


def test_wide_gram_equals_numpy(spark):
    """300 columns with large means; rows with a missing value go."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 300)) + np.linspace(-1e4, 1e4, 300)
    x[7, 3], x[9, 299] = np.nan, np.inf
    whole = np.delete(x, [7, 9], 0)
    out = linalg.wide_gram(_frame(spark, x), "v", 300).toPandas()
    assert len(out) == 300 * 301 // 2 and set(out["n"]) == {498}
    want = whole.T @ whole
    assert np.allclose(out["s"], want[out["i"], out["j"]], rtol=1e-12)
    cells = blocks.moment_cells(_frame(spark, x), "v", 300).toPandas()
    assert np.allclose(cells["m2"], np.cov(whole.T, ddof=0)[cells["i"], cells["j"]] * 498, atol=1e-6)


@pytest.mark.parametrize("width", [1, 127, 128, 129, 200])
def test_tiles_of_any_width(spark, width, monkeypatch):
    x = np.random.default_rng(width).normal(size=(40, width))
    groups = ["ab"[i % 2] if i % 5 else None for i in range(40)]
    monkeypatch.setattr(blocks, "HELD", 1)
    out = linalg.wide_gram(_frame(spark, x, groups), "v", width, ["g"]).toPandas()
    assert len(out) == 3 * width * (width + 1) // 2
    for g, own in out.groupby("g", dropna=False):
        rows = x[[i for i in range(40) if groups[i] == (g if isinstance(g, str) else None)]]
        assert np.allclose(own["s"], (rows.T @ rows)[own["i"], own["j"]])


def test_wide_gram_of_no_rows(spark):
    df = _frame(spark, np.ones((2, 70)))
    assert linalg.wide_gram(df.limit(0), "v", 70).count() == 0
    assert linalg.wide_gram(df.where("id < 0"), "v", 70).count() == 0


def test_wide_ols_correlations_and_components_equal_numpy(spark):
    rng = np.random.default_rng(2)
    names = [f"x{i}" for i in range(70)]
    x = rng.normal(size=(400, 70)) @ rng.normal(size=(70, 70)) / 8 + 3
    y = 2 + x @ rng.normal(size=70) + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in [*names, "y"]))
    got = {r["term"]: r["coef"] for r in linalg.ols(df, names, names, "y").collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert np.allclose([got[t] for t in ["Intercept", *names]], want, atol=1e-8)
    corr = {(r["a"], r["b"]): r["r"] for r in linalg.correlation_matrix(df, names).collect()}
    assert len(corr) == 4900 and np.allclose([corr[names[i], names[j]] for i in range(70) for j in range(70)], np.corrcoef(x.T).ravel())
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    first = np.abs(z @ np.linalg.eigh(np.corrcoef(x.T))[1][:, -1])
    assert np.allclose(sorted(abs(r["PC1"]) for r in pca_project(df, names, 2).collect()), sorted(first))


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) * [1, 10, 0.1, 1, 1] + [0, 100, 0, 0, 0]
    x[:, 4] = 7.0
    y = (x[:, 0] + (x[:, 1] - 100) / 10 + rng.normal(size=300) > 0.3).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(300)], "id long, y int, " + ", ".join(f"x{j} double" for j in range(5)))
    return evaluate.prepared(df, [f"x{j}" for j in range(5)], "y", "id", 3, 5)


_CONFIGS = [{"config_id": 4, "regParam": 0.0, "maxIter": 30}, {"config_id": 5, "regParam": 0.2, "maxIter": 30}, {"config_id": 6, "regParam": 0.1, "elasticNetParam": 0.7, "maxIter": 30}]


def test_shared_logistic_fits_equal_single_ones(spark, folds):
    fits = stacked.fit_logistic(folds, _CONFIGS, 3)
    for c, config in enumerate(_CONFIGS):
        alone = stacked.fit_logistic(folds, [config], 3)
        own = fits.coef[3 * c : 3 * c + 3]
        assert np.abs(alone.coef - own).max() < 1e-6 * (1 + np.abs(own).max())
        for f in range(3):
            rows = folds.where(F.col("fold") != f).select("label", array_to_vector("values").alias("features"))
            model = LogisticRegression(maxIter=500, tol=1e-13, regParam=config["regParam"], elasticNetParam=config.get("elasticNetParam", 0.0)).fit(rows)
            assert np.allclose(own[f], [model.intercept, *model.coefficients.toArray()], atol=1e-5)


def test_passes_do_not_grow_with_configurations(folds, monkeypatch):
    passes = []
    monkeypatch.setattr(stacked, "_newton_sums", lambda *a, f=stacked._newton_sums: passes.append(1) or f(*a))
    counts = []
    for n in (1, 12):
        passes.clear()
        stacked.fit_logistic(folds, [{"config_id": i, "regParam": 0.1, "maxIter": 30} for i in range(n)], 3)
        counts.append(len(passes))
    assert counts[0] == counts[1] <= 8
    # Models that don't fit one pass's sums take passes of their own, and come out alike.
    whole = stacked.fit_logistic(folds, _CONFIGS, 3).coef
    monkeypatch.setattr(stacked, "SUMS", 8 * 28 * 4)
    assert np.allclose(stacked.fit_logistic(folds, _CONFIGS, 3).coef, whole, atol=1e-9)


def test_separable_rows_end(spark):
    df = spark.createDataFrame([(i, int(i >= 20), float(i)) for i in range(40)], "id long, y int, x double")
    held = evaluate.prepared(df, ["x"], "y", "id", 2, 1)
    got = evaluate.cv_evaluate(held, [{"config_id": 0, "regParam": 0.0, "maxIter": 40}], k=2).first()
    assert got["Accuracy_Mean"] >= 0.9


def test_shared_metrics_equal_estimators(folds):
    for factory, configs in ((evaluate.logistic, _CONFIGS), (evaluate.bayes, [{"config_id": 1, "threshold": 0.5}, {"config_id": 2, "threshold": 0.9}])):
        slow = factory if factory is evaluate.bayes else lambda p: LogisticRegression(maxIter=500, tol=1e-13, regParam=p["regParam"], elasticNetParam=p.get("elasticNetParam", 0.0))
        single = (lambda p: NaiveBayes(modelType="gaussian", thresholds=[1 - p["threshold"], p["threshold"]])) if factory is evaluate.bayes else slow
        ours, theirs = ({r["config_id"]: [r[c] for c in ("Accuracy_Mean", "Precision_Mean", "Recall_Mean", "Specificity_Mean")] for r in evaluate.cv_evaluate(folds, configs, f, k=3).collect()} for f in (factory, single))
        assert ours.keys() == theirs.keys() and all(ours[c] == pytest.approx(theirs[c]) for c in ours)


def test_boosting_learns_what_single_splits_cannot(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, size=(400, 2))
    df = spark.createDataFrame([(i, int(x[i, 0] * x[i, 1] > 0), *map(float, x[i])) for i in range(400)], "id long, y int, a double, b double")
    config = {"subsample": 0.9, "colsample_bytree": 1.0, "colsample_bylevel": 1.0, "learning_rate": 0.3, "max_depth": 4, "gamma": 0.0, "n_estimators": 4}
    held = evaluate.prepared(df, ["a", "b"], "y", "id", 2, 1)
    got = evaluate.cv_evaluate(held, [{"config_id": 0, **config}], evaluate.boosting, k=2).first()
    assert got["Accuracy_Mean"] > 0.85 and got["Time_MeanFold"] > 0


def test_partitions_into_folds_share_passes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(i, int(x[i, 0] + rng.normal() > 0), *map(float, x[i])) for i in range(200)], "id long, y int, a double, b double, c double")
    many = evaluate.prepared_many(df, ["a", "b", "c"], "y", "id", 4, [7, 8, 9])
    for factory, own in ((evaluate.logistic, {"regParam": 0.1}), (evaluate.bayes, {"threshold": 0.4})):
        jobs = [(p, {"config_id": 5 * p + i, **{n: v * (i + 1) for n, v in own.items()}}) for p in (0, 2) for i in range(2)]
        got = {(r["part"], r["config_id"]): r["Precision_Mean"] for r in evaluate.cv_evaluate_many(many, jobs, factory, k=4).collect()}
        want = {}
        for p, seed in ((0, 7), (2, 9)):
            alone = evaluate.prepared(df, ["a", "b", "c"], "y", "id", 4, seed)
            want |= {(p, r["config_id"]): r["Precision_Mean"] for r in evaluate.cv_evaluate(alone, [c for q, c in jobs if q == p], factory, k=4).collect()}
        assert got == pytest.approx(want)


def test_a_newton_pass_holds_no_products_of_all_pairs(spark, monkeypatch):
    """64 variables and 40 models: the sums of a plain pass, from a few MB of blocks."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    n, width = 4_096, 64
    x, y, fold, held = rng.normal(size=(n, width)), rng.integers(0, 2, n).astype(float), rng.integers(0, 5, n), np.arange(40) % 5
    w = rng.normal(0, 0.1, (40, width + 1))
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array(fold), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width)], ["label", "fold", "values"])
    seen = []

    def here(df, sums):
        tracemalloc.start()
        found = {m: s for (m,), s in sums(iter([batch]))}
        seen.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return found

    monkeypatch.setattr(stacked, "summed", here)
    monkeypatch.setattr(stacked, "_collected", lambda found: found)
    data = spark.range(1).selectExpr("0D as label", "0 as fold", "array(0D) as values")
    scale = stacked.Scale(np.zeros(width), np.ones(width), np.zeros((1, 5)), np.zeros((1, 5, width)))
    got = stacked._newton_sums(data, width, scale, w, np.zeros(40, int), held)
    assert seen[0] < 40 << 20
    z = np.column_stack([np.ones(n), x])
    for m in (0, 39):
        own, p = fold != held[m], 1 / (1 + np.exp(-z @ w[m]))
        h = (z[own] * (p * (1 - p))[own, None]).T @ z[own]
        assert np.allclose(got[m], np.concatenate([[-(y * np.log(p) + (1 - y) * np.log(1 - p))[own].sum()], z[own].T @ (p - y)[own], h[np.triu_indices(width + 1)]]))
