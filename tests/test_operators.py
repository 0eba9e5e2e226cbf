"""Known answers, invariants and edge cases of the operators."""

from __future__ import annotations

import json
import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneline import session
from tuneline.functions import scalars as S
from tuneline.functions.scalars import Factor
from tuneline.operators import evaluate, factors, frontier, linalg, metrics, relational, sampling, search, surface
from tuneline.sources import tables


def _brute(points):
    out = {}
    for i, (g, a, t) in points.items():
        if g is None:
            continue
        out[i] = a is None or t is None or not any(h == g and b is not None and u is not None and b >= a and u <= t and (b > a or u < t) for h, b, u in points.values())
    return out


@pytest.mark.parametrize("operator", [relational.pareto_front, relational.skyline_2d])
def test_front_equals_brute_force(spark, operator):
    rng = random.Random(1)
    pick = lambda values: rng.choice([*values, None])
    points = {i: (pick("abc"), pick([1.0, 2.0, 3.0, 4.0]), pick([1.0, 2.0, 3.0, 4.0])) for i in range(300)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "i int, g string, a double, t double")
    assert {r["i"]: r["is_pareto"] for r in operator(df, ["g"], "a", "t").collect()} == _brute(points)
    kept = operator(df, ["g"], "a", "t", drop_missing=True).where("is_pareto and (a is null or t is null)")
    assert kept.count() == 0
    assert operator(df.limit(0), ["g"], "a", "t").count() == 0


def test_win_rate_ignores_nan_and_null_groups(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("n", 1, float("nan")), ("n", 2, 0.5), ("m", None, 1.0), (None, 2, 0.5)], "method string, replica int, v double")
    got = {r["method"]: (r["wins"], r["n"], r["win_rate"]) for r in metrics.win_rate(df, "method", "replica", "v").collect()}
    assert got == {"m": (1, 2, 0.5), "n": (1, 2, 0.5)}


def test_folds_are_balanced_and_stable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    first = relational.assign_folds(df, "y", "id", 5, 42)
    again = relational.assign_folds(df.repartition(3, "y"), "y", "id", 5, 42)
    assert first.exceptAll(again).count() == 0
    for by in (["fold"], ["fold", "y"]):
        n = [r["count"] for r in first.groupBy(*by).count().collect()]
        if by == ["fold"]:
            assert max(n) - min(n) <= 1
    for y in (0, 1):
        n = [r["count"] for r in first.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert max(n) - min(n) <= 1


def test_folds_of_many_classes_and_seeds(spark):
    """Many classes (a null one too), null keys, and several seeds at once: ranks by (label, hash, key), modulo k."""
    df = spark.range(3000).select(F.when(F.col("id") % 500 > 0, F.col("id") % 500).alias("y"), F.when(F.col("id") != 77, F.col("id")).alias("id"))
    got = relational.assign_folds(df, "y", "id", 7, 42).collect()
    assert len(got) == 3000
    want = sorted(got, key=lambda r: (r["y"] is not None, r["y"] or 0, hashlib.md5(f"42-{r['id']}".encode()).hexdigest() if r["id"] is not None else "", r["id"] or 0))
    assert [r["fold"] for r in want] == [i % 7 for i in range(3000)]
    plan = relational.assign_folds(df, "y", "id", 7, 42)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    whole = df.where("id is not null")
    many = {r["id"]: r["folds"] for r in relational.assign_folds_many(whole, "y", "id", 7, [5, 42]).collect()}
    for i, seed in enumerate((5, 42)):
        assert {r["id"]: r["fold"] for r in relational.assign_folds(whole, "y", "id", 7, seed).collect()} == {k: f[i] for k, f in many.items()}


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, 3.5, "nan"), (0.5, -1.5, "7")], "a double, b double, s string")
    cast = S.cast_factors(df, {"a": Factor(0, 9, True), "b": Factor(0, 9)}).collect()
    assert [(r["a"], r["b"]) for r in cast] == [(2, 3.5), (0, -1.5)]
    assert [r["s"] for r in S.to_number(df, ["s"]).collect()] == [None, 7.0]
    assert [r[0] for r in df.select(S.slug(F.lit(" ä.b/c_"))).collect()] == ["ä_bc"] * 2
    assert [r[0] for r in df.select(S.slug(F.lit("._ "))).collect()] == ["item"] * 2
    assert [r[0] for r in df.select(S.term_expr("x", ["a"], "compat") + S.term_expr("x^2", ["a"], "compat") + S.term_expr("1/x", ["a"], "compat")).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        S.term_expr("x", ["a"])
    with pytest.raises(ValueError):
        S.transform_time(F.col("a"), "sqrt")
    assert df.select(S.normalize_range(F.col("a"), F.lit(1.0), F.lit(1.0), clip=True)).first()[0] == 0


def test_zscore_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 3.0), (None, 1.0), (None, 3.0)], "g string, v double")
    got = sorted((r["g"] or "", r["v_z"]) for r in factors.zscore(df, ["v"], ["g"]).where("g is not null").collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", None)]
    assert factors.zscore(df.limit(0), ["v"]).count() == 0


def test_t_tail():
    for t, free, p in ((2.0, 10, 0.0733880), (12.7062, 1, 0.05), (0.0, 5, 1.0)):
        assert linalg.t_tail(t, free) == pytest.approx(p, abs=1e-6)


def test_surface_recovers_planted_terms_and_matches_refits(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform([50, 0.01, 3], [700, 0.3, 18], (400, 3))
    y = 2 + 0.01 * x[:, 0] - 30 * x[:, 1] + 0.05 * x[:, 0] * x[:, 1] + rng.normal(0, 0.05, 400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "n double, r double, d double, y double")
    found = surface.fit_surface(df, ["n", "r", "d"], "y")
    held = dict(found.pairs())
    assert {"Intercept", "n", "r", "n*r"} <= set(held)
    assert held["n*r"] == pytest.approx(0.05, rel=0.02) and held["r"] == pytest.approx(-30, rel=0.05)

    def columns(names):
        return np.stack([np.prod([x[:, "nrd".index(f)] for f in t.split("*")], 0) if t != "Intercept" else np.ones(400) for t in names], 1)

    names = S.quadratic_terms(["n", "r", "d"])
    while True:
        m = columns(names) / np.abs(columns(names)).max(0)
        coef = np.linalg.lstsq(m, y, rcond=None)[0]
        free = 400 - len(names)
        error = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * ((y - m @ coef) ** 2).sum() / free)
        p = [linalg.t_tail(abs(c) / e, free) for c, e in zip(coef, error, strict=True)]
        out = [i for i, t in enumerate(names) if p[i] > 0.05 and surface._removable(t, names)]
        if not out:
            break
        names.pop(max(out, key=lambda i: (p[i], -i)))
    assert set(names) == set(held)


def test_surface_by_group_and_collinear(spark):
    df = spark.range(60).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.col("id").cast("double").alias("y"))
    held = {g: {r["term"]: r for r in surface.surfaces_by(df, ["a", "b"], "y", ["g"]).where(F.col("g") == g).collect()} for g in (0, 1)}
    for g, found in held.items():
        alone = surface.fit_surface(df.where(F.col("g") == g), ["a", "b"], "y")
        assert set(found) == set(alone.terms)
        for t, c in alone.pairs():
            assert found[t]["coef"] == pytest.approx(c) and found[t]["r2"] == pytest.approx(alone.r2) and found[t]["n"] == alone.n == 30
    assert surface.surfaces_by(df.withColumn("g", F.lit(None).cast("long")), ["a", "b"], "y", ["g"]).count() == 0
    one = surface.surfaces_by(df.withColumn("a", F.lit(2.0)), ["a"], "y", ["g"], on_singular="pinv").where("term = 'Intercept'")
    assert one.count() == 2
    with pytest.raises(ValueError, match="collinear"):
        surface.fit_surface(df.withColumn("b", F.col("a") * 2), ["a", "b"], "y")
    assert surface.fit_surface(df.withColumn("b", F.col("a") * 2), ["a", "b"], "y", on_singular="pinv")
    with pytest.raises(ValueError, match="complete"):
        surface.fit_surface(df.limit(0), ["a", "b"], "y")


def test_factor_scores_of_a_planted_model(spark):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(2, 500))
    noise = rng.normal(size=(5, 500))
    m = [q + 0.2 * noise[0], q + 0.3 * noise[1], q + 0.4 * noise[2], noise[3], np.expm1(np.abs(c) + 1)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.stack(m, 1))], "i int, Accuracy_Mean double, Precision_Mean double, Recall_Mean double, Specificity_Mean double, Time_MeanFold double")
    out, found = factors.factor_scores(df)
    loading = np.abs(found.loadings)
    assert loading[:3, found.quality].min() > 0.5 and loading[4, found.cost] > 0.9 and found.loadings[4, found.cost] > 0
    check = factors.score_sanity(out, "Score_Cost", "Time_MeanFold").first()
    assert check["corr"] < -0.8 and not check["warn"]
    spread = out.agg(F.avg("Score_Cost"), F.stddev_samp("Score_Cost")).first()
    assert spread[0] == pytest.approx(0, abs=1e-9) and spread[1] == pytest.approx(1)
    with pytest.raises(ValueError, match="missing columns"):
        factors.factor_scores(df.drop("Recall_Mean"))


@pytest.mark.parametrize("combine", [True, False])
def test_factor_scores_by_group_equal_those_of_each_group(spark, combine):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(90, 5)) + rng.normal(size=(90, 1)) * [1, 1, 0.5, 0.2, 0]
    m[:, 4] = np.exp(m[:, 4])
    names = factors.DEFAULT_METRICS
    df = spark.createDataFrame([(i, [None, 1, 2][i % 3], *map(float, r)) for i, r in enumerate(m)] + [(90, 3, 1.0, 1.0, 1.0, 1.0, 1.0)], "i int, g int, " + ", ".join(f"{n} double" for n in names))
    weights = [1.0, 3.0] if combine else None
    out = {r["i"]: r for r in factors.factor_scores_by(df, ["g"], weights=weights, combine=combine).collect()}
    assert len(out) == 91 and out[90]["Score_Quality"] is None
    for g in (None, 1, 2):
        alone, _ = factors.factor_scores(df.where(F.col("g").eqNullSafe(F.lit(g))), weights=weights, combine=combine)
        for r in alone.collect():
            for c in ("FACTOR1_SCORE", "FACTOR2_SCORE", "FACTOR3_SCORE", "Score_Quality", "Score_Cost"):
                assert out[r["i"]][c] == pytest.approx(r[c], abs=1e-6)


def test_frontier_is_monotone_and_beats_sampling(spark):
    box = {"a": Factor(0, 1), "b": Factor(0, 10, True)}
    first = surface.Surface("q", ["Intercept", "a", "a*a", "b"], [0, 2, -2, 0.1], 1, 1, 0.05, 9)
    second = surface.Surface("c", ["Intercept", "a", "b"], [1, -1, -0.3], 1, 1, 0.05, 9)
    found = frontier.frontier_search(spark, first, second, box, step=0.25, starts=4, samples=40, rounds=5).orderBy("beta_2").collect()
    assert [r["beta_2"] for r in found] == [0.25, 0.5, 0.75, 1.0] and all(r["success"] for r in found)
    costs = [r["Pred_Score_Cost"] for r in found]
    assert all(x <= y + 1e-3 for x, y in zip(costs, costs[1:], strict=False))
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 1, 20_000), rng.uniform(0, 10, 20_000)
    for r in found:
        best = (r["beta_1"] * (2 * a - 2 * a * a + 0.1 * b) + r["beta_2"] * (1 - a - 0.3 * b)).max()
        assert r["score"] >= best - 0.02
    none = frontier.frontier_search(spark, first, second, box, step=0.5, starts=2, samples=5, rounds=1, utopia=(99.0, 99.0), nadir=(98.0, 98.0), keep_in_range=True).collect()
    assert not any(r["success"] for r in none)
    with pytest.raises(ValueError):
        frontier.beta_pairs(0.001)


def test_random_configs_do_not_depend_on_partitions(spark):
    box = {"a": Factor(0.5, 1.5), "k": Factor(2, 4, True)}
    df = sampling.random_configs(spark, box, 2_000, 9)
    assert df.exceptAll(sampling.random_configs(spark, box, 2_000, 9).repartition(7)).count() == 0
    ends = df.agg(F.min("a"), F.max("a"), F.collect_set("k")).first()
    assert 0.5 <= ends[0] and ends[1] < 1.5 and sorted(ends[2]) == [2.0, 3.0, 4.0]


def test_grid(spark):
    assert sampling.grid_product(spark, {"a": [1.0, 2.0], "b": [5.0, 6.0, 7.0]}).select("a", "b").distinct().count() == 6
    levels = sampling.factor_levels(spark, {"k": Factor(1, 2, True)}, 100)
    assert sorted(r["level"] for r in levels.collect()) == [1.0, 2.0]


def test_decimal_comma_and_terms(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "x"), (2, None, "y")], "i int, v double, s string")
    tables.write_decimal_comma(df, f"{tmp_path}/t")
    assert sorted((r["i"], r["v"], r["s"]) for r in tables.read_csv_auto(spark, f"{tmp_path}/t").collect()) == [(1.0, 1.5, "x"), (2.0, None, "y")]
    odd = spark.createDataFrame([("a*b", "1,25")], "`My Terms` string, `Std Coefficient` string")
    assert tables.terms_of(odd).first().asDict() == {"term": "a*b", "coef": 1.25}
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        tables.find_column(["x"], ("term",))


def test_candidates(spark):
    df = spark.createDataFrame([("{'a': 1, 'b': 2.5}",), ("{'a': None, 'b': 1}",), ("junk",), (None,), ("{'b': 1}",)], "hyperparameters string")
    assert [(r["a"], r["b"]) for r in tables.read_candidates(df, ["a", "b"]).collect()] == [(1.0, 2.5)]
    assert tables.read_candidates(df, ["a", "b"], on_bad="null").count() == 5


def test_labels(spark):
    df = spark.createDataFrame([(1.0, "g"), (2.0, "h"), (3.0, "z")], "x double, class string")
    assert [r["label"] for r in tables.split_label(df, label_map={"g": 0, "h": 1}).collect()] == [0, 1, None]
    assert [r["label"] for r in tables.split_label(df, label_map={"q": 0}).collect()] == ["g", "h", "z"]
    with pytest.raises(ValueError):
        tables.split_label(df, target="nope")


def test_best_and_top(spark):
    df = spark.createDataFrame([(3, 0.9), (1, 0.9), (2, float("nan")), (0, None)], "seq int, m double")
    assert relational.best_config(df, "m", "seq").first()["seq"] == 1
    assert relational.best_config(df.where("m is null"), "m", "seq").count() == 0
    assert [r["seq"] for r in relational.top_k_by_distance(df, F.col("seq") * 1.0, "seq", 2).collect()] == [0, 1]
    assert relational.top_k_by_distance(df, F.col("seq"), "seq", 0).count() == 4


def test_front_of_three_objectives(spark):
    rng = random.Random(2)
    points = [(i, rng.choice("ab"), rng.randint(1, 5), rng.randint(1, 5), rng.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(points, "i int, g string, x int, y int, z int")
    want = {p[0]: p[4] is None or not any(q[1] == p[1] and q[4] is not None and q[2] >= p[2] and q[3] >= p[3] and q[4] <= p[4] and (q[2:4] != p[2:4] or q[4] < p[4]) for q in points) for p in points}
    assert {r["i"]: r["is_pareto"] for r in relational.pareto_front(df, ["g"], ["x", "y"], "z").collect()} == want


def test_uncombined_scores_take_one_weight(spark):
    df = spark.createDataFrame([(1.0, 4.0, 7.0), (2.0, 5.0, 9.0), (9.0, 1.0, 8.0)], "f1 double, f2 double, f3 double")
    got = [r["Score_Quality"] for r in factors.combine_scores(df, ["f1", "f2", "f3"], "f3", "f1", [2.0], combine=False).collect()]
    assert sorted(got) == pytest.approx([-3 / 19**0.5, -2 / 19**0.5, 5 / 19**0.5])
    with pytest.raises(ValueError, match="weights"):
        factors.combine_scores(df, ["f1", "f2", "f3"], "f3", "f1", [1.0, 2.0], combine=False)


def test_sample_n(spark):
    df = spark.range(1000).repartition(5)
    want = [r["id"] for r in df.orderBy(sampling.shuffle_key(3, F.col("id")), "id").limit(700).collect()]
    assert sorted(r["id"] for r in sampling.sample_n(df, 700, 3, "id").collect()) == sorted(want)
    assert sampling.sample_n(df, 5000, 3, "id").count() == 1000 and sampling.sample_n(df, 0, 3, "id").count() == 0


def test_intermediates_have_an_owner(spark):
    with session.scratch(spark):
        held = session.materialize(spark.range(5), "owned")
        path = held.inputFiles()[0]
        assert held.count() == 5 and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_exports_of_candidates_and_fits(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, 0.5, 1.5, {"a": 2.0}), (0.75, 0.25, 1.25, {"a": 3.0})], "beta_1 double, beta_2 double, score double, hyperparameters map<string,double>")
    tables.export_candidates(rows, f"{tmp_path}/c")
    back = tables.read_candidates(tables.read_decimal_comma(spark, f"{tmp_path}/c", ["beta_2", "score"]), ["a"])
    assert sorted((r["beta_2"], r["score"], r["a"]) for r in back.collect()) == [(0.25, 1.25, 3.0), (0.5, 1.5, 2.0)]
    found = factors.Rotation(["m", "t"], np.zeros(2), np.ones(2), np.eye(2), 1, 0)
    tables.export_fit(spark, {"quality": surface.Surface("q", ["Intercept"], [1.0], 0.5, 0.4, 0.05, 9)}, found, f"{tmp_path}/f")
    assert json.loads(spark.read.text(f"{tmp_path}/f").first()[0]) == {"quality": {"r2": 0.5, "r2_adj": 0.4, "alpha": 0.05, "n_terms": 1}, "fa": {"quality_factor": 1, "cost_factor": 2}}
    tables.export_loadings(found.frame(spark), f"{tmp_path}/l")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/l").collect()) == [("m", 1.0, 0.0), ("t", 0.0, 1.0)]
    tables.export_scores(spark.createDataFrame([(7, 0.5, 1)], "id int, Score_Cost double, x int"), "id", f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").first().asDict() == {"Row": 7, "Score_Cost": 0.5}


def test_number_rows(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"))
    assert [r["seq"] for r in tables.number_rows(df, ["k"]).orderBy("k").collect()] == list(range(500))


def test_ols_equals_lstsq(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double")
    got = {r["term"]: r["coef"] for r in linalg.ols(df, ["a", "b"], ["a", "b"], "y").collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert [got[t] for t in ("Intercept", "a", "b")] == pytest.approx(list(want)) and not math.isnan(want[0])


def test_prepared_rows_are_complete(spark):
    whole = [(i, i % 2, float(i), 1.5 * i) for i in range(20)]
    df = spark.createDataFrame([*whole, (20, 1, None, 1.0), (21, 0, 1.0, float("nan")), (22, None, 1.0, 1.0)], "id long, y int, a double, b double")
    held = evaluate.prepared(df, ["b", "a"], "y", "id", 4, 1).collect()
    assert {r["_key"]: (r["label"], r["values"]) for r in held} == {i: (y, [b, a]) for i, y, a, b in whole}
    assert {r["fold"] for r in held} == {0, 1, 2, 3}
    wide = spark.range(50).select("id", (F.col("id") % 2).alias("y"), *[(F.col("id") * i).alias(f"x{i}") for i in range(64)])
    assert {len(r["values"]) for r in evaluate.prepared(wide, [f"x{i}" for i in range(64)], "y", "id", 2, 1).collect()} == {64}
    with pytest.raises(ValueError, match="missing columns"):
        evaluate.prepared(df, ["c"], "y", "id", 4, 1)


def test_density_pick_sums_a_history_up(spark):
    rng = np.random.default_rng(4)
    # Ties around the cut, nulls, values at and beyond the box's ends.
    past = [(None if i % 41 == 0 else round(float(rng.random()), 1), float(rng.uniform(-0.1, 1.1)), None if i % 29 == 0 else int(rng.integers(1, 9))) for i in range(700)]
    pool = [(i, float(rng.random()), int(rng.integers(1, 9))) for i in range(300)]
    box = {"x": Factor(0.0, 1.0), "y": Factor(1, 8, True)}
    rows = spark.createDataFrame(past, "Accuracy_Mean double, x double, y int")
    ranks = [sum(1 for q in past if q[0] is not None and (p[0] is None or q[0] > p[0])) / (len(past) - 1) for p in past]

    def density(v, at, width, good):
        held = [np.exp(-(((v - p[at]) / width) ** 2) / 2) for p, r in zip(past, ranks, strict=True) if (r <= 0.25) == good and p[at] is not None]
        return np.log(np.mean(held) + 1e-12)

    ratio = {c: density(x, 1, 0.2, True) - density(x, 1, 0.2, False) + density(y, 2, 1.4, True) - density(y, 2, 1.4, False) for c, x, y in pool}
    asked = spark.createDataFrame(pool, "config_id long, x double, y int")
    found = search.density_pick(rows, asked.union(asked), box, 12)
    assert [r["config_id"] for r in found.collect()] == sorted(ratio, key=lambda c: (-ratio[c], c))[:12] and found.schema["y"].dataType == asked.schema["y"].dataType
    # Neither a window over the whole history nor pairs of history and pool.
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    for share in (0.0, 0.1, 1.0):
        want = [r <= share for r in ranks]
        assert [r[0] for r in rows.select(search._good_from(rows, share)).collect()] == want


def test_failed_replicas_are_rows(spark):
    from tuneline.plans import pipeline

    def broken(params):
        raise RuntimeError("no model")

    data = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("y"), F.col("id").cast("double").alias("x"))
    box = {"regParam": Factor(0.0, 0.5)}
    job = (data, ["x"], "y", "id", sampling.random_configs(spark, box, 2, 1), box, [(0, 42), (1, 43)])
    out = pipeline.replicate(*job, k=2, factory=broken).orderBy("replica").collect()
    assert [(r["replica"], r["seed"], r["status"]) for r in out] == [(0, 42, "failed"), (1, 43, "failed")] and "no model" in out[0]["error"]
    with pytest.raises(RuntimeError, match="no model"):
        pipeline.replicate(*job, k=2, factory=broken, stop_at_failure=True)


def test_replicas_together_equal_single_ones(spark):
    """Bayes with one factor: every replica of the joint run has the metrics and candidates that it gets alone."""
    from tuneline.plans import pipeline

    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    data = spark.createDataFrame([(i, int(x[i].sum() + rng.normal() > 0.4), *map(float, x[i])) for i in range(120)], "id long, y int, a double, b double")
    box = {"threshold": Factor(0.1, 0.9)}
    design = sampling.random_configs(spark, box, 9, 3)
    more = dict(k=3, top=3, factory=evaluate.bayes, baselines=("grid",), search={"step": 0.25, "starts": 3, "samples": 10, "rounds": 2}, metrics=["Accuracy_Mean", "Precision_Mean", "Recall_Mean", "Specificity_Mean"])
    out = pipeline.replicate(data, ["a", "b"], "y", "id", design, box, [(0, 42), (1, 43), (2, 44)], stop_at_failure=True, **more).collect()
    assert sorted((r["replica"], r["method"], r["status"]) for r in out) == [(i, m, "ok") for i in range(3) for m in ("grid", "main")]
    names = ("Accuracy_Mean", "Precision_Mean", "Recall_Mean", "Specificity_Mean", "budget")
    for replica, seed in ((0, 42), (1, 43), (2, 44)):
        alone = {r["method"]: r for r in pipeline.replica_pipeline(data, ["a", "b"], "y", "id", design, box, seed, **more).collect()}
        for r in out:
            if r["replica"] == replica:
                assert [r[n] for n in names] == pytest.approx([alone[r["method"]][n] for n in names])
                assert r["hyperparameters"] == pytest.approx(alone[r["method"]]["hyperparameters"])


def test_polish_finds_planted_optima(spark):
    """Bowls with a known best point, inside the box and at its ends; the range is kept, and no point gets worse."""
    rng = np.random.default_rng(5)
    names = ["a", "b", "c"]
    lo, hi = np.zeros(3), np.array([1.0, 2.0, 3.0])
    for inside in (True, False):
        best = rng.uniform(0.1, 0.9, 3) * hi if inside else np.array([1.0, 0.0, 1.5])
        pull = best + (0 if inside else np.array([5.0, -5.0, 0.0]))
        root = rng.normal(size=(3, 3))
        h = root @ root.T + np.eye(3) if inside else np.diag([1.0, 2.0, 0.5])
        coef = {"Intercept": -pull @ h @ pull, **{n: 2 * (h @ pull)[i] for i, n in enumerate(names)}, **{f"{n}*{n}": -h[i, i] for i, n in enumerate(names)}, **{f"{names[i]}*{names[j]}": -2 * h[i, j] for i in range(3) for j in range(i + 1, 3)}}
        array = np.array([[coef[t] for t in S.quadratic_terms(names)]] * 20)
        x = rng.uniform(0, 1, (20, 3)) * hi
        quadratics = [frontier._quadratics(array, 3), frontier._quadratics(0 * array, 3)]
        out = frontier.polish(x, lo, hi, quadratics, np.tile([1.0, 0.0], (20, 1)), None, True)
        assert np.allclose(out, best, atol=1e-6)
        value = lambda z: -np.einsum("ni,ij,nj->n", z - pull, h, z - pull)  # noqa: B023, E731
        edge = np.full(20, float(value(best[None])[0] - 0.5))
        ranged = frontier.polish(x, lo, hi, quadratics, np.tile([1.0, 0.0], (20, 1)), [(np.full(20, -1e9), edge), (np.full(20, -1.0), np.full(20, 1.0))], True)
        ok = value(x) <= edge
        assert (value(ranged)[ok] >= value(x)[ok] - 1e-12).all() and (value(ranged)[ok] <= edge[ok] + 1e-9).all() and np.allclose(value(ranged)[ok], edge[ok], atol=1e-6)
        assert np.allclose(ranged[~ok], x[~ok])


def test_frontier_by_group_equals_single_ones(spark):
    box = {"a": Factor(0, 1), "b": Factor(0, 10, True)}
    held = {g: [surface.Surface("q", ["Intercept", "a", "a*a", "b"], [0, 2 + g, -2, 0.1], 1, 1, 0.05, 9), surface.Surface("c", ["Intercept", "a", "b", "b*a"], [1, -1, -0.3, 0.01 * g], 1, 1, 0.05, 9)] for g in range(3)}
    groups = spark.createDataFrame([(g, 7 + g, *[frontier.coefficients(s, list(box)) for s in pair]) for g, pair in held.items()], "g int, seed long, quality array<double>, cost array<double>")
    more = dict(step=0.5, starts=3, samples=10, rounds=2)
    out = frontier.frontier_search_by(groups, ["g"], box, **more).collect()
    for g, pair in held.items():
        alone = {r["beta_2"]: r for r in frontier.frontier_search(spark, *pair, box, seed=7 + g, **more).collect()}
        mine = {r["beta_2"]: r for r in out if r["g"] == g}
        assert mine.keys() == alone.keys() and all(mine[b]["score"] == pytest.approx(alone[b]["score"]) and mine[b]["hyperparameters"] == alone[b]["hyperparameters"] for b in alone)
    # Terms that aren't quadratic are searched without polish.
    odd = surface.Surface("q", ["Intercept", "1/b"], [1.0, 2.0], 1, 1, 0.05, 9)
    assert frontier.frontier_search(spark, odd, held[0][1], box, step=1.0, starts=2, samples=5, rounds=1).first()["success"]


@pytest.mark.parametrize(("a", "b"), [(1, 1), (1, 7), (7, 1), (3, 3), (16, 9), (2, 500)])
def test_the_permutation_is_one(spark, a, b):
    found = [(r["l"], r["r"]) for r in sampling.permuted_pairs(spark, a, b, a * b, 5).orderBy("i").collect()]
    assert sorted(found) == [(x, y) for x in range(a) for y in range(b)]
    if a * b > 50:
        assert found != sorted(found) and found != [(r["l"], r["r"]) for r in sampling.permuted_pairs(spark, a, b, a * b, 6).orderBy("i").collect()]
    with pytest.raises(ValueError):
        sampling.permuted_pairs(spark, a, b, a * b + 1, 5)


def test_points_of_a_huge_grid(spark):
    """Fifty of 3^20 points, and of more than an integer counts, without making the grid."""
    for d in (20, 60):
        levels = {f"x{i}": [0.0, 1.0, 2.0] for i in range(d)}
        found = sampling.permuted_grid(spark, levels, 50, 1)
        rows = {tuple(r[f"x{i}"] for i in range(d)) for r in found.collect()}
        assert len(rows) == 50 and {v for r in rows for v in r} == {0.0, 1.0, 2.0}
    one = sampling.permuted_grid(spark, {"k": [float(i) for i in range(11)]}, 10, 1)
    assert len({r["k"] for r in one.collect()}) == 10
    every = sampling.permuted_grid(spark, {"a": [1.0, 2.0], "b": [5.0, 6.0]}, 9, 1)
    assert len({(r["a"], r["b"]) for r in every.collect()}) == 4
    # How often each level is picked is even: 2,000 of 40 x 40 x 40 points.
    many = sampling.permuted_grid(spark, {n: [float(i) for i in range(40)] for n in "abc"}, 2_000, 3).collect()
    for n in "abc":
        counts = np.bincount([int(r[n]) for r in many], minlength=40)
        assert 20 <= counts.min() and counts.max() <= 85
    box = {"k": Factor(1, 3, True), "m": Factor(1, 2, True)}
    few = [(r["k"], r["m"]) for r in sampling.distinct_configs(spark, box, 30, 2).collect()]
    assert len(few) == len(set(few)) == 6


def test_surrogate_picks_equal_a_plain_posterior(spark):
    rng = np.random.default_rng(7)
    box = {"a": Factor(0.0, 2.0), "b": Factor(-1.0, 1.0)}
    past = rng.uniform([0, -1], [2, 1], (25, 2))
    y = np.sin(2 * past[:, 0]) + past[:, 1] ** 2
    history = spark.createDataFrame([(float(v), *map(float, r)) for v, r in zip(y, past, strict=True)] + [(None, 0.0, 0.0)], "Accuracy_Mean double, a double, b double")
    points = rng.uniform([0, -1], [2, 1], (500, 2))
    pool = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(points)], "config_id long, a double, b double").repartition(3)
    got = {r["config_id"]: r for r in search.surrogate_scores(history, pool, box, (0.3,), (0.01,)).collect()}
    unit = lambda x: (x - [0, -1]) / [2, 2]
    kernel = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(2) / (2 * 0.3**2))
    held = kernel(unit(past), unit(past)) + 0.01 * np.eye(25)
    k, z = kernel(unit(points), unit(past)), (y - y.mean()) / y.std()
    mean = y.mean() + y.std() * k @ np.linalg.solve(held, z)
    deviation = y.std() * np.sqrt(1 - np.einsum("ij,ij->i", k, np.linalg.solve(held, k.T).T))
    assert np.allclose([got[i]["mean"] for i in range(500)], mean) and np.allclose([got[i]["deviation"] for i in range(500)], deviation)
    t = (mean - y.max()) / deviation
    gain = np.array([(m - y.max()) * 0.5 * (1 + math.erf(v / math.sqrt(2))) + s * math.exp(-v * v / 2) / math.sqrt(2 * math.pi) for m, s, v in zip(mean, deviation, t, strict=True)])
    assert np.allclose([got[i]["improvement"] for i in range(500)], gain)
    # Length and noise by the likelihood; the picks follow the improvement.
    best = search.surrogate_scores(history, pool, box).orderBy(F.desc("improvement"), "config_id").limit(5).collect()
    assert [r["config_id"] for r in search.surrogate_pick(history, pool, box, 5).collect()] == [r["config_id"] for r in best]
    with pytest.raises(ValueError):
        search.surrogate_scores(history.where("Accuracy_Mean is null"), pool, box)


def test_history_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(search, "HISTORY", 3)
    rows = spark.range(4).select(F.col("id").alias("config_id"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("Accuracy_Mean"))
    with pytest.raises(ValueError, match="history"):
        search.surrogate_scores(rows, rows, {"x": Factor(0, 4)})


def test_files_of_any_size_are_fingerprinted(spark, tmp_path, monkeypatch):
    """Three gigabytes, which no row can hold, beside small files; and files that only the driver can open."""
    wanted = {}
    for name, size in (("small", 1000), ("large", 3 << 30)):
        path = tmp_path / name
        digest = hashlib.sha256()
        with open(path, "wb") as f:
            f.write(b"x" * min(size, 10))
            f.truncate(size)
        with open(path, "rb") as f:
            while step := f.read(1 << 24):
                digest.update(step)
        wanted[name] = (size, digest.hexdigest())
    named = lambda df: {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in df.collect()}
    assert named(tables.file_fingerprints(spark, str(tmp_path))) == wanted
    (tmp_path / "large").unlink()
    del wanted["large"]
    assert named(tables.file_fingerprints(spark, str(tmp_path), whole=-1)) == wanted
    import pyarrow as pa

    def closed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.string())], ["path", "length", "sha256"])

    monkeypatch.setattr(tables, "_streamed", closed)
    assert named(tables.file_fingerprints(spark, str(tmp_path), whole=-1)) == wanted


def test_grouped_scores_with_factors_of_their_own_number(spark):
    """Three groups whose metrics have two, three and five eigenvalues of weight: each as it is alone."""
    rng = np.random.default_rng(3)
    names = ["m1", "m2", "m3", "m4", "m5", "m6", "Time_MeanFold"]
    rows = []
    for g, sources in (("a", 1), ("b", 4), ("c", 7)):
        base = rng.normal(size=(80, sources))
        x = base[:, np.arange(7) % sources] + rng.normal(size=(80, 7)) * 0.2
        rows += [(g, i, *map(float, r[:6]), float(np.exp(r[6] / 4))) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, ("a", 99, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "g string, i int, " + ", ".join(f"{n} double" for n in names))
    out = factors.factor_scores_by(df, ["g"], names, automatic=True).collect()
    counts = set()
    for g in "abc":
        alone, found = factors.factor_scores(df.where(F.col("g") == g), names, automatic=True)
        counts.add(k := found.loadings.shape[1])
        want = {r["i"]: r for r in alone.collect()}
        mine = {r["i"]: r for r in out if r["g"] == g}
        assert mine.keys() == want.keys() and 99 not in mine
        for i, r in want.items():
            for c in [*(f"FACTOR{j + 1}_SCORE" for j in range(k)), "Score_Quality", "Score_Cost"]:
                assert mine[i][c] == pytest.approx(r[c], abs=1e-9)
            assert all(mine[i][c] is None for c in mine[i].asDict() if c.startswith("FACTOR") and int(c[6:-6]) > k)
    assert len(counts) > 1
    with pytest.raises(ValueError, match="missing"):
        factors.factor_scores_by(df, ["g"], names, on_missing="error")
    with pytest.raises(ValueError, match="weights"):
        factors.factor_scores_by(df.dropna(), ["g"], names, automatic=True, weights=[1.0, 2.0])


def test_blocks_delete_their_own_tables_only(spark):
    """Two threads of one driver, one of which ends its block while the other still reads; and a block in a block."""
    import threading

    written, ended, found = threading.Event(), threading.Event(), []

    def other():
        with session.scratch(spark):
            table = session.materialize(spark.range(5), "theirs")
            written.set()
            ended.wait(60)
            found.append(table.count())
        with pytest.raises(Exception):  # noqa: B017
            table.count()
        found.append("gone")

    thread = threading.Thread(target=other)
    thread.start()
    with session.scratch(spark):
        written.wait(60)
        mine = session.materialize(spark.range(3), "mine")
        with session.scratch(spark):
            inner = session.materialize(spark.range(2), "inner")
        with pytest.raises(Exception):  # noqa: B017
            inner.count()
        assert mine.count() == 3
    ended.set()
    thread.join()
    assert found == [5, "gone"]
    assert session.materialize(spark.range(4), "kept").count() == 4


def test_replicas_of_constant_metrics_have_candidates(spark):
    """Penalties that leave no coefficient give every row of the design the same metrics, which correlate with nothing."""
    from tuneline.plans import pipeline

    data = spark.range(60).select("id", (F.col("id") % 3 < 2).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("x"))
    box = {"regParam": Factor(50.0, 60.0), "elasticNetParam": Factor(0.5, 1.0)}
    more = dict(k=3, top=2, baselines=(), search={"step": 0.5, "starts": 3, "samples": 5, "rounds": 1})
    job = (data, ["x"], "y", "id", sampling.random_configs(spark, box, 8, 1), box)
    alone = pipeline.replica_pipeline(*job, 42, **more).collect()
    both = pipeline.replicate(*job, [(0, 42)], stop_at_failure=True, **more).collect()
    for r in [*alone, *both]:
        assert (r["method"], r["Accuracy_Mean"], r["Recall_Mean"], r["Specificity_Mean"]) == ("main", pytest.approx(2 / 3), 1.0, 0.0)


def test_correlations_of_constants_are_missing(spark):
    df = spark.createDataFrame([(float(i), 5.0, float(i * i)) for i in range(6)], "a double, b double, c double")
    corr = {(r["a"], r["b"]): r["r"] for r in linalg.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert corr["a", "c"] == pytest.approx(np.corrcoef(range(6), [i * i for i in range(6)])[0, 1]) and corr["a", "a"] == pytest.approx(1)
    assert all(corr[p] is None for p in corr if "b" in p)
    assert linalg.moments(df, ["a", "b", "c"])[2][1].tolist() == [0.0, 1.0, 0.0]
    assert factors.score_sanity(df, "b", "a").first().asDict() == {"n": 6, "corr": None, "warn": False}


def test_surfaces_of_few_groups_do_not_deal_rows_out_by_group(spark):
    """Boxes of three groups are broadcast from the start, so no task gets a group's rows."""
    rows = spark.range(200_000).selectExpr("id % 3 as g", "cast(id % 11 as double) as a", "cast(id % 7 + id % 11 as double) as y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        out = surface.surfaces_by(rows, ["a"], "y", ["g"], alpha=1.0)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        fits = {(r["g"], r["term"]): r["coef"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    i = np.arange(200_000)
    for g in range(3):
        a, y = i[i % 3 == g] % 11, (i % 7 + i % 11)[i % 3 == g]
        assert [fits[g, "a*a"], fits[g, "a"], fits[g, "Intercept"]] == pytest.approx(np.polyfit(a, y, 2).tolist(), abs=1e-6)
