"""Whole analyses: one replica, many replicas, and the aggregation of their runs."""

from __future__ import annotations

import time
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneline.functions.scalars import Factor, cast_factors, distance_to_utopia, fill_midpoint, normalize_range
from tuneline.operators.evaluate import Factory, cv_evaluate_many, evaluate_candidates, evaluate_many, logistic, prepared, prepared_many, run_design
from tuneline.operators.factors import factor_scores, factor_scores_by
from tuneline.operators.frontier import frontier_search, frontier_search_by
from tuneline.operators.metrics import extremes, method_stats, pareto_rate, win_rate
from tuneline.operators.relational import dedup_configs, skyline_2d, top_k_by_distance, union_ragged
from tuneline.operators.search import density_search, equal_budget, grid_search, random_search, summary, surrogate_search
from tuneline.operators.surface import coefficient_arrays, fit_surface, surfaces_by
from tuneline.session import materialize, require_columns
from tuneline.sources.tables import read_candidates

#: Columns whose statistics are reported.
STAT_COLUMNS = ["Accuracy_Mean", "Precision_Mean", "Recall_Mean", "Specificity_Mean", "Time_MeanFold", "Optimization_Time_Seconds", "Total_Time_Seconds", "budget"]

SCORES = ["Score_Quality", "Score_Cost"]


def aggregate_runs(runs: DataFrame) -> dict[str, DataFrame]:
    """stats, win_rate, pareto and pareto_rate of a runs table (replica, seed, method, Accuracy_Mean, Time_MeanFold and more)."""
    require_columns(runs, "replica", "seed", "method", "Accuracy_Mean", "Time_MeanFold")
    front = skyline_2d(runs, ["replica"], "Accuracy_Mean", "Time_MeanFold")
    return {
        "stats": method_stats(runs, "method", STAT_COLUMNS),
        "win_rate": win_rate(runs, "method", "replica", "Accuracy_Mean"),
        "pareto": front.select("replica", "seed", "method", "Accuracy_Mean", "Time_MeanFold", "is_pareto"),
        "pareto_rate": pareto_rate(front, "method", "replica"),
    }


def pick_candidates(candidates: DataFrame, factors: dict[str, Factor], k: int, utopia: tuple[float, float], nadir: tuple[float, float]) -> DataFrame:
    """Candidates with factors filled, distinct, and the k whose predictions, scaled by the observed ``nadir`` and ``utopia``, lie nearest to utopia."""
    rows = fill_midpoint(read_candidates(candidates, list(factors), on_bad="null"), factors)
    rows = rows.withColumn("seq", F.round(F.col("beta_2") * 100).cast("long"))
    rows = dedup_configs(rows, list(factors), "seq")
    near = [normalize_range(F.col(c), F.lit(float(lo)), F.lit(float(hi)), clip=True) for c, lo, hi in zip(("Pred_Score_Quality", "Pred_Score_Cost"), nadir, utopia, strict=True)]
    return top_k_by_distance(rows, distance_to_utopia(*near), "seq", k).select(F.col("seq").alias("config_id"), *factors)


def replica_pipeline(data: DataFrame, features: list[str], label: str, key: str, design: DataFrame, factors: dict[str, Factor], seed: int, k: int = 5, top: int = 50, budget: int = 0, factory: Factory = logistic, baselines: tuple[str, ...] = ("grid", "random", "surrogate", "density"), search: dict | None = None, metrics: list[str] | None = None) -> DataFrame:
    """The method summary of one replica: design, scores, surfaces, candidates, confirmation, baselines on an equal budget.

    Each stage is written to the shared folder before the next reads it.
    """
    began = time.perf_counter()
    folds = prepared(data, features, label, key, k, seed)
    done = materialize(run_design(folds, design, factors, factory, k), "design")
    scored, _ = factor_scores(done, metrics)
    scored = materialize(scored, "scores")
    surfaces = [fit_surface(scored, list(factors), y, on_singular="pinv") for y in SCORES]
    ends = extremes(scored, SCORES).first()
    utopia, nadir = tuple(ends[f"{y}_utopia"] for y in SCORES), tuple(ends[f"{y}_nadir"] for y in SCORES)
    found = frontier_search(scored.sparkSession, *surfaces, factors, seed=seed, utopia=utopia, nadir=nadir, design=scored, **(search or {}))
    chosen = materialize(pick_candidates(found, factors, top, utopia, nadir), "candidates")
    best, _ = evaluate_candidates(folds, chosen, factors, factory, k)
    own = design.count() + chosen.count()
    spent = equal_budget(budget, own, 0)
    rows = [summary(best, "main", own, time.perf_counter() - began)]
    searches = {"grid": grid_search, "random": random_search, "surrogate": surrogate_search, "density": density_search}
    for name in baselines:
        rows.append(searches[name](folds, factors, spent, seed=seed, factory=factory, k=k))
    return materialize(union_ragged(rows), "summary")


def pick_candidates_by(candidates: DataFrame, by: list[str], factors: dict[str, Factor], k: int, ends: DataFrame) -> DataFrame:
    """pick_candidates() of each group: (by, config_id, factors). ``ends`` has the keys, and utopia and nadir of both scores."""
    rows = fill_midpoint(read_candidates(candidates, list(factors), on_bad="null"), factors)
    rows = dedup_configs(rows.withColumn("seq", F.round(F.col("beta_2") * 100).cast("long")), [*by, *factors], "seq").join(ends, by)
    near = [normalize_range(F.col(c), F.col(f"{y}_nadir").cast("double"), F.col(f"{y}_utopia").cast("double"), clip=True) for c, y in zip(("Pred_Score_Quality", "Pred_Score_Cost"), SCORES, strict=True)]
    # A group has as many candidates as there are weight pairs, a hundred at most.
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(distance_to_utopia(*near)), "seq")
    ranked = rows.withColumn("_rank", F.row_number().over(order))
    return (ranked if k <= 0 else ranked.where(F.col("_rank") <= k)).select(*by, F.col("seq").alias("config_id"), *factors)


def _all_together(folds: DataFrame, keys: DataFrame, design: DataFrame, factors: dict[str, Factor], k: int, top: int, factory: Factory, search: dict | None, metrics: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The best candidate and the number of candidates of every replica of ``keys`` (part, replica, seed), each stage for all of them."""
    names, by = list(factors), ["replica", "seed"]
    rows = sorted((r.asDict() for r in cast_factors(design.select("config_id", *factors), factors).collect()), key=lambda r: r["config_id"])
    parts = [r["part"] for r in keys.select("part").collect()]
    done = cv_evaluate_many(folds, [(p, r) for p in parts for r in rows], factory, k)
    designs = materialize(design.drop(*by, "part").join(done, "config_id").join(keys, "part").drop("part"), "designs")
    scored = factor_scores_by(designs, by, metrics)
    ends = materialize(extremes(scored, SCORES, by), "ends")
    groups = ends.select(*by, *[F.col(f"{y}_{e}").cast("double").alias(f"{e}_{i}") for i, y in enumerate(SCORES, 1) for e in ("nadir", "utopia")])
    for y, name in zip(SCORES, ("quality", "cost"), strict=True):
        groups = groups.join(coefficient_arrays(surfaces_by(scored, names, y, by, on_singular="pinv"), names, by, name), by)
    found = frontier_search_by(materialize(groups, "groups"), by, factors, design=scored, **(search or {}))
    chosen = materialize(pick_candidates_by(found, by, factors, top, ends).join(keys, by), "candidates")
    tried = evaluate_many(folds, chosen, factors, factory, k).join(keys, "part").drop("part")
    best = tried.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("Accuracy_Mean"), "config_id"))).where("_rank = 1").drop("_rank")
    return materialize(best, "best"), chosen.groupBy(*by).count()


def replicate(data: DataFrame, features: list[str], label: str, key: str, design: DataFrame, factors: dict[str, Factor], seeds: list[tuple[int, int]], stop_at_failure: bool = False, k: int = 5, top: int = 50, budget: int = 0, factory: Factory = logistic, baselines: tuple[str, ...] = ("grid", "random", "surrogate", "density"), search: dict | None = None, metrics: list[str] | None = None) -> DataFrame:
    """The runs table of all (replica, seed) pairs, with replica, seed and status in front; a failed replica is a row with its error.

    Folds, designs, scores, surfaces, frontiers and candidates of all replicas are computed together, in as many jobs
    as one replica takes; baselines go replica by replica. Where that fails, or a replica has no candidate, the
    replicas concerned are run by themselves, which tells whose failure it is. ``key`` is unique.
    """
    spark, began, done, failed = data.sparkSession, time.perf_counter(), [], []

    def tagged(df: DataFrame, replica: int, seed: int, *more) -> DataFrame:
        return df.select(F.lit(replica).cast("long").alias("replica"), F.lit(seed).cast("long").alias("seed"), *more, *[F.col(f"`{c}`") for c in df.columns if c not in ("replica", "seed", "id")])

    def fail(replica: int, seed: int, e: Exception) -> None:
        if stop_at_failure:
            raise e
        failed.append(tagged(spark.range(1), replica, seed, F.lit("failed").alias("status"), F.lit(str(e)[:500]).alias("error")))

    try:
        folds = prepared_many(data, features, label, key, k, [s for _, s in seeds])
        keys = spark.createDataFrame([(i, r, s) for i, (r, s) in enumerate(seeds)], "part int, replica long, seed long")
        best, counts = _all_together(folds, keys, design, factors, k, top, factory, search, metrics)
        chosen, designed = {(r["replica"], r["seed"]): r["count"] for r in counts.collect()}, design.count()
    except Exception as e:
        if stop_at_failure:
            raise
        warnings.warn(f"replicas are run one by one: {str(e)[:200]}", stacklevel=2)
        chosen = {}
    shared = (time.perf_counter() - began) / len(seeds)
    searches = {"grid": grid_search, "random": random_search, "surrogate": surrogate_search, "density": density_search}
    for part, (replica, seed) in enumerate(seeds):
        try:
            if (replica, seed) not in chosen:
                out = replica_pipeline(data, features, label, key, design, factors, seed, k, top, budget, factory, baselines, search, metrics)
            else:
                own = designed + chosen[replica, seed]
                held = best.where((F.col("replica") == replica) & (F.col("seed") == seed)).drop("replica", "seed")
                rows, mine = [summary(held, "main", own, shared)], folds.withColumn("fold", F.get("fold", F.lit(part)))
                rows += [searches[b](mine, factors, equal_budget(budget, own, 0), seed=seed, factory=factory, k=k) for b in baselines]
                out = materialize(union_ragged(rows), "summary") if baselines else rows[0]
            done.append(tagged(out, replica, seed, F.lit("ok").alias("status")))
        except Exception as e:
            fail(replica, seed, e)
    return union_ragged([*done, *failed])
