"""Order statistics by histograms against sorting."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneline.operators import metrics, selection


def _rows(rng):
    special = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, math.nextafter(1.0, 2), None, math.nan, math.inf, -math.inf]
    out = [("a", float(rng.choice([1.0, 2.0, 3.0])), None) for _ in range(301)]
    out += [("b", special[int(rng.integers(len(special)))], float(rng.normal())) for _ in range(200)]
    out += [(None, float(rng.normal() * 10.0 ** rng.integers(-200, 200)), 7.0) for _ in range(150)]
    return [*out, ("c", 4.0, None)]


def _want(rows, place):
    out = {}
    for g in {r[0] for r in rows}:
        for c, name in ((1, "v"), (2, "w")):
            held = sorted(r[c] for r in rows if r[0] == g and r[c] is not None and math.isfinite(r[c]))
            out |= {(g, name, k): held[k] for k in place(len(held)) if 0 <= k < len(held)}
    return out


def test_ranks_equal_sorting(spark, monkeypatch):
    rows = _rows(np.random.default_rng(1))
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(6)
    ranks = F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.expr("n div 3"), F.expr("n div 2"), F.col("n") - 1, F.col("n"))
    want = _want(rows, lambda n: {0, n // 3, n // 2, n - 1})
    for few in (selection._FEW, 0):
        monkeypatch.setattr(selection, "_FEW", few)
        got = {(r["g"], r["column"], r["rank"]): r["value"] for r in selection.select_ranks(df, ["g"], ["v", "w"], ranks).collect()}
        assert got == want
    alone = selection.select_ranks(df, [], ["v"], F.array(F.col("n") - 1)).collect()
    assert [(r["n"], r["value"]) for r in alone] == [(sum(r[1] is not None and math.isfinite(r[1]) for r in rows), max(r[1] for r in rows if r[1] is not None and math.isfinite(r[1])))]
    assert selection.select_ranks(df.limit(0), ["g"], ["v"], ranks).count() == 0


@pytest.mark.parametrize("held", [0, 140, 200])
def test_sorted_and_counted_groups_meet(spark, monkeypatch, held):
    """All groups are counted, or those of up to so many values are sorted, with groups joined by broadcast and by hash."""
    rows = _rows(np.random.default_rng(3))
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(6)
    sizes = {n for c in (1, 2) for g in "abc" if (n := sum(r[0] == g and r[c] is not None and math.isfinite(r[c]) for r in rows))}
    assert any(n > held for n in sizes) and any(n <= held for n in sizes) == bool(held)
    want = _want(rows, lambda n: {0, n // 2, n - 1})
    for few in (selection._FEW, 0):
        monkeypatch.setattr(selection, "_FEW", few)
        found = selection.select_ranks(df, ["g"], ["v", "w"], F.array(F.lit(0), F.expr("n div 2"), F.col("n") - 1), held).collect()
        assert {(r["g"], r["column"], r["rank"]): r["value"] for r in found} == want and len(found) == len(want)


def test_rows_of_small_groups_are_dealt_out_by_their_number(spark, monkeypatch):
    """A task that sorts has as many rows as a part should have, and not what adaptive execution makes of packed bytes."""
    monkeypatch.setattr(selection, "_PART", 1_000, raising=False)
    df = spark.range(0, 40_000, 1, 4).select((F.col("id") % 4_000).alias("g"), F.lit(1.0).alias("v"))
    out = selection.select_ranks(df, ["g"], ["v"], F.array(F.lit(0), F.col("n") - 1))
    assert out.rdd.getNumPartitions() == 40 and out.count() == 8_000


def test_rows_are_not_sorted_for_a_join_with_many_places(spark):
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    for n, kind in ((1, "BroadcastHashJoin"), (selection._FEW + 1, "ShuffledHashJoin")):
        joined = rows.join(selection._few(rows.select("x").distinct(), n), "x", "left_semi")
        assert kind in joined._jdf.queryExecution().executedPlan().toString()


def test_no_window_or_task_holds_a_group(spark):
    """A histogram of one large group has as many rows as a digit has values, not as the group."""
    df = spark.range(0, 400_000, 1, 8).select(F.lit("g").alias("g"), F.rand(3).alias("v"))
    got = selection.select_ranks(df, ["g"], ["v"], F.array(F.expr("n div 2"))).first()
    held = np.sort(df.toArrow()["v"].to_numpy())
    assert got["value"] == held[200_000]


def test_statistics_of_large_groups_equal_small_ones(spark):
    rows = _rows(np.random.default_rng(2))
    df = spark.createDataFrame(rows, "method string, v double, w double")
    small, large = ({r["method"]: r.asDict() for r in metrics.method_stats(df, "method", ["v", "w", "absent"], held=h).collect()} for h in (1_000_000, 10))
    assert small.keys() == large.keys() == {"a", "b", "c", None}
    for m, r in small.items():
        for c, v in r.items():
            assert large[m][c] == v or math.isclose(large[m][c], v, rel_tol=1e-12) or (v != v and large[m][c] != large[m][c])
    sketch = metrics.method_stats(df, "method", ["w"], approximate=True)
    assert sketch.columns == ["method", *(f"w_{s}" for s in metrics.STATISTICS)] and sketch.count() == 4
