"""Fronts of three objectives and more against brute force, whatever the shape of the points."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneline.operators import relational, skyline


def _brute(x):
    return {tuple(r) for i, r in enumerate(x) if not ((x >= r).all(1) & (x > r).any(1)).any()}


def _shapes(rng, n, d):
    plane = rng.dirichlet(np.ones(d), n)
    return {"uniform": rng.random((n, d)), "plane": plane, "ties": rng.integers(0, 6, (n, d)).astype(float), "line": np.repeat(rng.random((n, 1)), d, 1), "flat": np.column_stack([plane[:, :-1], np.zeros(n)])}


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_local_fronts_equal_brute_force(d):
    for x in _shapes(np.random.default_rng(d), 700, d).values():
        x = np.unique(x, axis=0)
        assert {tuple(r) for r in x[skyline.front(x)]} == _brute(x)
    # Sums that rounding makes equal.
    x = np.array([[1e16, 1.0, 0.0], [1e16, 0.0, 0.0], [1e16, 0.5, 0.0]])
    assert skyline.front(x).tolist() == [0]


@pytest.mark.parametrize("d", [3, 4])
def test_grid_equals_brute_force(spark, monkeypatch, d):
    """Parts and cells so small that every way is taken."""
    monkeypatch.setattr(skyline, "PART", 60)
    monkeypatch.setattr(skyline, "CELL", 12)
    shapes = {k: np.unique(x, axis=0) for k, x in _shapes(np.random.default_rng(7), 500, d).items()}
    values = [f"v{i}" for i in range(d)]
    df = spark.createDataFrame([(k, *map(float, r)) for k, x in shapes.items() for r in x], "g string, " + ", ".join(f"{v} double" for v in values))
    got: dict[str, set] = {k: set() for k in shapes}
    rows = skyline.skyline(df, ["g"], values).collect()
    for r in rows:
        got[r["g"]].add(tuple(r[v] for v in values))
    assert len(rows) == sum(map(len, got.values())) and got == {k: _brute(x) for k, x in shapes.items()}
    alone = {tuple(r) for r in skyline.skyline(df.where("g = 'plane'").drop("g"), [], values).collect()}
    assert alone == got["plane"]


def test_pareto_front_of_three(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2] if i % 11 else None, *[None if rng.random() < 0.05 else float(v) for v in rng.integers(0, 8, 3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g string, a double, b double, t double")
    got = {r["i"]: r["is_pareto"] for r in relational.pareto_front(df, ["g"], ["a", "b"], "t").collect()}
    for i, g, *v in rows:
        if g is None:
            assert i not in got
            continue
        better = lambda w: None not in w and w[0] >= v[0] and w[1] >= v[1] and w[2] <= v[2] and list(w) != list(v)  # noqa: B023, E731
        assert got[i] == (None in v or not any(better(w) for _, h, *w in rows if h == g))
    assert relational.pareto_front(df, [], ["a", "b"], "t", drop_missing=True).where("is_pareto").count() > 0
    assert relational.pareto_front(df.limit(0), ["g"], ["a", "b"], "t").count() == 0


def test_a_million_points_of_one_group(spark):
    """Points near a plane, most of which are on the front: no task gets more than a small part of them."""
    u = lambda s: F.rand(s)
    df = spark.range(0, 1_000_000, 1, 8).select(u(1).alias("a"), u(2).alias("b"), u(3).alias("c"))
    near = df.select("a", "b", (2 - F.col("a") - F.col("b") + F.col("c") * 0.05).alias("c"))
    found = skyline.skyline(near, [], ["a", "b", "c"])
    n = found.count()
    assert n > skyline.PART
    sample = np.array(found.limit(2_000).toArrow().to_pandas())
    some = np.array(near.limit(20_000).toArrow().to_pandas())
    assert skyline.undominated(sample, sample).all() and skyline.undominated(sample, some).all()
