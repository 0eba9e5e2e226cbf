"""Pareto fronts of any number of objectives, without a task that holds a group and without comparing all pairs.

Parts of bounded size keep their own fronts first, which leaves little of most tables. What is left of a
large group is dealt into grid cells by quantiles of each objective. A cell below another one in
every objective is dominated whole; any other cell's points can only be dominated from cells that are no
lower in any objective, and are compared with those alone, in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tuneline.session import materialize

#: Points of a part that are compared among themselves, points of a cell that the grid aims at, and cells of a group's grid at most.
PART, CELL, CELLS = 8_192, 1_000, 20_000
#: Points compared at once.
_STEP = 256


def undominated(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` no row of ``others`` is at least as good as everywhere and better than somewhere."""
    keep = np.ones(len(x), bool)
    for i in range(0, len(x), _STEP):
        own = x[i : i + _STEP]
        for j in range(0, len(others), 4096):
            part = others[j : j + 4096]
            no_worse, equal = np.ones((len(own), len(part)), bool), np.ones((len(own), len(part)), bool)
            for c in range(x.shape[1]):
                no_worse &= part[None, :, c] >= own[:, None, c]
                equal &= part[None, :, c] == own[:, None, c]
            keep[i : i + _STEP] &= ~(no_worse & ~equal).any(1)
    return keep


def front(x: np.ndarray) -> np.ndarray:
    """The places of the front of the rows of ``x``, larger being better: sorted so that no row dominates an earlier one, then filtered."""
    # Sums are monotone even as rounded; of equal ones the larger row in lexical order can dominate.
    order = np.lexsort([*(-x[:, c] for c in reversed(range(x.shape[1]))), -x.sum(1)])
    kept = np.zeros(0, np.int64)
    for i in range(0, len(order), _STEP):
        own = order[i : i + _STEP]
        own = own[undominated(x[own], x[kept])] if len(kept) else own
        kept = np.concatenate([kept, own[undominated(x[own], x[own])]])
    return kept


def _numbers(t: pa.Table | pa.RecordBatch, values: list[str]) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy() for c in values])


def _fronts(points: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The front of each group of ``keys``, which are groups of bounded size."""

    def own(t: pa.Table) -> pa.Table:
        return t.take(pa.array(np.sort(front(_numbers(t, values)))))

    return points.groupBy(*keys).applyInArrow(own, points.schema)


def _grid(survivors: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``survivors`` (by, values, _n of the group) with _cell, an array of a bin for each objective, by quantiles of the group."""
    d = len(values)
    bins = F.least(F.ceil(F.pow(F.col("_n") / CELL, F.lit(1 / max(1, d - 1)))), F.lit(max(2, int(CELLS ** (1 / d))))).cast("int")
    # Five hundredths of a percent of error move points between neighbouring bins, which costs balance and nothing else.
    cuts = survivors.groupBy(*by, "_n").agg(*[F.percentile_approx(c, [i / 256 for i in range(1, 256)], 2_000).alias(f"_cuts{i}") for i, c in enumerate(values)])
    held = survivors.join(cuts.withColumn("_bins", bins), [*by, "_n"])
    below = lambda i, c: F.size(F.filter(f"_cuts{i}", lambda q: q < F.col(c)))
    bin_of = [F.floor(below(i, c) * F.col("_bins") / 256).cast("int") for i, c in enumerate(values)]
    return held.select(*by, *values, F.array(*bin_of).alias("_cell"))


def _meetings(cells: DataFrame, by: list[str], d: int) -> DataFrame:
    """(by, _cell, _target): for each cell that isn't dominated whole, itself and the cells that can hold dominating points."""

    def pairs(t: pa.Table) -> pa.Table:
        c = np.array(t.column("_cell").to_pylist(), np.int32).reshape(-1, d)
        alive = np.zeros(len(c), bool)
        for i in range(0, len(c), _STEP):
            alive[i : i + _STEP] = ~(c[None] > c[i : i + _STEP, None]).all(2).any(1)
        left = c[alive]
        target, source = [], []
        for i in range(0, len(left), _STEP):
            a, b = np.nonzero((left[None] >= left[i : i + _STEP, None]).all(2))
            target.append(a + i), source.append(b)
        target, source = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (target, source))
        own = [pa.array([t.column(k)[0].as_py()] * len(target), t.schema.field(k).type) for k in by]
        lists = [pa.array(left[p].tolist(), pa.list_(pa.int32())) for p in (source, target)]
        return pa.Table.from_arrays([*own, *lists], [*by, "_cell", "_target"])

    kinds = StructType([cells.schema[k] for k in by] + [StructField("_cell", cells.schema["_cell"].dataType), StructField("_target", cells.schema["_cell"].dataType)])
    return cells.groupBy(*by).applyInArrow(pairs, kinds)


def _merged(points: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """The front of large groups, whose points (by, values, _n) are fronts of parts."""
    celled = materialize(_fronts(_grid(points, by, values), [*by, "_cell"], values), "cells")
    meet = materialize(_meetings(celled.select(*by, "_cell").distinct(), by, len(values)), "meetings")
    rows = celled.join(meet, [*by, "_cell"]).withColumn("_other", (F.col("_cell") != F.col("_target")).cast("int"))
    keys = len(by)

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, table, keep = None, None, [], None

        def done() -> pa.RecordBatch:
            own = pa.Table.from_batches(table).combine_chunks()
            kept = own.filter(pa.array(keep)) if keep is not None else own
            return kept.to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], schema=own.schema)

        for b in batches:
            names = [b.column(i).to_pylist() for i in range(keys)] + [b.column("_target").to_pylist(), b.column("_other").to_pylist()]
            rows = list(zip(*names, strict=True))
            at = 0
            while at < b.num_rows:
                end = at
                while end < b.num_rows and rows[end] == rows[at]:
                    end += 1
                part, own = b.slice(at, end - at), (rows[at][:-2], tuple(rows[at][-2]))
                if own != key:
                    if table:
                        yield done()
                    key, held, table, keep = own, None, [], None
                if rows[at][-1] == 0:
                    # A cell's own points, which come first, are its front; they are held, and others stream past them.
                    table.append(part.select([*by, *values]))
                else:
                    if held is None:
                        held = _numbers(pa.Table.from_batches(table), values)
                        keep = np.ones(len(held), bool)
                    left = np.flatnonzero(keep)
                    keep[left] = undominated(held[left], _numbers(part, values))
                at = end
        if table:
            yield done()

    kinds = StructType([points.schema[c] for c in [*by, *values]])
    sorted_ = rows.select(*by, *values, "_target", "_other").repartition(*by, "_target").sortWithinPartitions(*by, "_target", "_other")
    return sorted_.mapInArrow(survive, kinds)


def skyline(points: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """The rows of ``points`` (by, values; distinct, nothing missing) that no other row of their group dominates, larger being better.

    Groups of any size and number; equal to comparing all pairs. ``by`` may be empty.
    """
    points = points.select(*by, *values)
    keyed = by or ["_all"]
    if not by:
        points = points.withColumn("_all", F.lit(0))
    points = materialize(points, "points")
    parts = max(1, -(-points.count() // PART))
    salted = points.withColumn("_salt", F.pmod(F.xxhash64(*values), F.lit(parts)))
    local = materialize(_fronts(salted, [*keyed, "_salt"], values).drop("_salt"), "local-fronts")
    sizes = local.groupBy(*keyed).agg(F.count(F.lit(1)).alias("_n"))
    sized = local.join(sizes, keyed)
    small = _fronts(sized.where(F.col("_n") <= PART).drop("_n"), keyed, values)
    large = sized.where(F.col("_n") > PART)
    out = small if large.isEmpty() else small.unionByName(_merged(large, keyed, values))
    return out.select(*by, *values)
