"""Cross-validated evaluation of configurations on a distributed table."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tuneline.functions.scalars import Factor, cast_factors
from tuneline.operators.metrics import confusion_metrics, fold_means
from tuneline.operators.relational import assign_folds, assign_folds_many, best_config
from tuneline.operators.stacked import Cells, bayes_cells, logistic_cells
from tuneline.session import materialize, require_columns

Factory = Callable[[dict], object]


def logistic(params: dict) -> LogisticRegression:
    """The cheap default: regParam, elasticNetParam and maxIter by name."""
    known = {k: v for k, v in params.items() if k in ("regParam", "elasticNetParam")}
    return LogisticRegression(maxIter=int(params.get("maxIter", 20)), **known)


def bayes(params: dict) -> NaiveBayes:
    """Gaussian naive Bayes, fitted in one aggregate; class 1 is predicted where its probability is above ``threshold``."""
    cut = float(params.get("threshold", 0.5))
    return NaiveBayes(modelType="gaussian", thresholds=[1 - cut, cut])


def boosting(params: dict, seed: int = 42) -> GBTClassifier:
    """Boosted trees from the seven boosting factors; the column samples of tree and level multiply into the one per node that Spark has."""
    columns = params.get("colsample_bytree", 1.0) * params.get("colsample_bylevel", 1.0)
    return GBTClassifier(seed=seed, subsamplingRate=params.get("subsample", 1.0), stepSize=params.get("learning_rate", 0.1), maxDepth=min(30, int(params.get("max_depth", 5))), maxIter=int(params.get("n_estimators", 20)), minInfoGain=params.get("gamma", 0.0), featureSubsetStrategy=str(min(1.0, max(1e-3, columns))))


def _complete(data: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    require_columns(data, *features, label, key)
    # One array in place of a column a feature, with which 64 features hadn't ended after two minutes.
    rows = data.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("label"), F.array(*[F.col(c).cast("double") for c in features]).alias("values")).dropna()
    return rows.where(F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x)))


def prepared(data: DataFrame, features: list[str], label: str, key: str, k: int, seed: int) -> DataFrame:
    """(_key, label, fold, values) of complete rows, written once: every configuration uses the same folds."""
    rows = _complete(data, features, label, key)
    return materialize(assign_folds(rows, "label", "_key", k, seed).select("_key", "label", "fold", "values"), "folds")


def prepared_many(data: DataFrame, features: list[str], label: str, key: str, k: int, seeds: list[int]) -> DataFrame:
    """prepared() for several seeds at once: fold is an array of the fold that each seed gives. ``key`` is unique."""
    rows = materialize(_complete(data, features, label, key), "rows")
    folds = assign_folds_many(rows, "label", "_key", k, seeds)
    return materialize(rows.join(folds, "_key").select("_key", "label", F.col("folds").alias("fold"), "values"), "folds")


#: Models that are fitted for all configurations and folds in shared passes.
SHARED = {logistic: logistic_cells, bayes: bayes_cells}


def _one_by_one(data: DataFrame, configs: list[dict], parts: list[int], factory: Factory, k: int, parallel: int) -> Cells:
    """Cells and seconds of models that Spark's estimators fit, a job of its own for each configuration and fold."""
    many = isinstance(data.schema["fold"].dataType, ArrayType)
    data = data.select("label", "fold", array_to_vector("values").alias("features")).cache()
    try:
        def one(job: tuple[int, int]) -> tuple[list, tuple[int, int, float]]:
            place, fold = job
            own = F.get("fold", F.lit(parts[place])) if many else F.col("fold")
            began = time.perf_counter()
            model = factory({n: v for n, v in configs[place].items() if n != "config_id"}).fit(data.where(own != fold))
            found = model.transform(data.where(own == fold)).select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))
            counts = [(place, fold, *r) for r in found.groupBy("y", "pred").count().collect()]
            return counts, (place, fold, time.perf_counter() - began)

        with ThreadPoolExecutor(parallel) as pool:
            done = list(pool.map(one, [(c, f) for c in range(len(configs)) for f in range(k)]))
    finally:
        data.unpersist()
    # Four counts for each configuration and fold came back.
    return [r for counts, _ in done for r in counts], [t for _, t in done]


def cv_evaluate(data: DataFrame, configs: list[dict], factory: Factory = logistic, k: int = 5, parallel: int = 4) -> DataFrame:
    """(config_id, four means, Time_MeanFold) of every configuration over the k folds that prepared() made.

    Models of SHARED are fitted all together, in passes whose number doesn't grow with the configurations, and
    their seconds are shares of the passes'; those of other factories are fitted one by one on the distributed table, ``parallel`` at a time,
    and their seconds cover fit and prediction. ``configs`` are dictionaries with config_id.
    """
    return cv_evaluate_many(data, [(0, c) for c in configs], factory, k, parallel).drop("part")


def cv_evaluate_many(data: DataFrame, jobs: list[tuple[int, dict]], factory: Factory = logistic, k: int = 5, parallel: int = 4) -> DataFrame:
    """cv_evaluate() of configurations of several partitions into folds: (part, config_id, ...).

    ``data`` comes from prepared_many() and a job is the place of its seed there and a configuration;
    models of all jobs share the passes.
    """
    if not jobs:
        raise ValueError("no configurations")
    parts, configs = [p for p, _ in jobs], [c for _, c in jobs]
    cells, seconds = SHARED[factory](data, configs, k, parts) if factory in SHARED else _one_by_one(data, configs, parts, factory, k, parallel)
    spark, name = data.sparkSession, lambda place: (parts[place], configs[place]["config_id"])
    counted = spark.createDataFrame([(*name(c), *r) for c, *r in cells], "part int, config_id long, fold int, y int, pred int, n long")
    spent = spark.createDataFrame([(*name(c), *r) for c, *r in seconds], "part int, config_id long, fold int, seconds double")
    return fold_means(confusion_metrics(counted, ["part", "config_id", "fold"], weight="n").join(spent, ["part", "config_id", "fold"]), ["part", "config_id"], "seconds")


def _rows(configs: DataFrame, factors: dict[str, Factor]) -> list[dict]:
    return [r.asDict() for r in cast_factors(configs.select("config_id", *factors), factors).orderBy("config_id").collect()]


def run_design(data: DataFrame, design: DataFrame, factors: dict[str, Factor], factory: Factory = logistic, k: int = 5, parallel: int = 4) -> DataFrame:
    """Every design row, its columns as given, with the metrics of the configuration that it rounds to."""
    require_columns(design, "config_id", *factors)
    return design.join(cv_evaluate(data, _rows(design, factors), factory, k, parallel), "config_id")


def evaluate_candidates(data: DataFrame, candidates: DataFrame, factors: dict[str, Factor], factory: Factory = logistic, k: int = 5, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """(best, all): candidates cast, evaluated, and the first of the most accurate."""
    rows = _rows(candidates, factors)
    if not rows:
        raise ValueError("no candidates")
    found = cv_evaluate(data, rows, factory, k, parallel)
    spec = cast_factors(candidates.select("config_id", *factors), factors)
    out = found.join(spec, "config_id").withColumn("hyperparameters", _as_map(factors)).drop(*factors)
    return best_config(out, "Accuracy_Mean", "config_id"), out


def _as_map(factors: dict[str, Factor]) -> Column:
    return F.create_map(*[x for n in factors for x in (F.lit(n), F.col(n).cast("double"))])


def evaluate_many(data: DataFrame, candidates: DataFrame, factors: dict[str, Factor], factory: Factory = logistic, k: int = 5, parallel: int = 4) -> DataFrame:
    """(part, config_id, four means, Time_MeanFold, hyperparameters) of ``candidates`` (part, config_id, factors), all in shared passes.

    ``data`` comes from prepared_many(). Candidates, each of which is k model fits, reach the driver.
    """
    held = cast_factors(candidates.select("part", "config_id", *factors), factors)
    rows = sorted((r.asDict() for r in held.collect()), key=lambda r: (r["part"], r["config_id"]))
    found = cv_evaluate_many(data, [(r.pop("part"), r) for r in rows], factory, k, parallel)
    return found.join(held, ["part", "config_id"]).withColumn("hyperparameters", _as_map(factors)).drop(*factors)

