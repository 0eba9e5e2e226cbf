"""Sums over a whole table that are arrays: each task adds its Arrow blocks up, and tasks' arrays are merged by key.

Column-wise aggregates need an expression for every number that they sum, and Spark stops compiling
them after some thousands. Here a task holds one array a key, whatever its length, and gives it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tuneline.functions.scalars import no_nan
from tuneline.session import require_columns

#: Tasks that one pass is dealt out to at most, and so arrays of a key that are merged.
TASKS = 4_096
#: Bytes of the arrays that a task holds before it hands them on.
HELD = 256 << 20
#: Rows whose products are taken at once, and columns of a tile.
ROWS, TILE = 2_048, 128


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def summed(df: DataFrame, sums: Callable, merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add, keys: str = "tile int") -> DataFrame:
    """(keys, sums): the arrays that ``sums`` makes of each task's rows, merged by key in the order of the tasks.

    ``sums`` takes an iterator of Arrow batches and yields pairs of a tuple of key values and an array. A task
    merges one stream of sorted arrays, two at a time, so no key's arrays are held together.
    """
    names = StructType.fromDDL(keys).names

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, (key, array) in enumerate(sums(batches)):
            yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, kinds, strict=True)), pa.array([_part() * 1_000_000 + n], pa.int64()), pa.array([array], pa.list_(pa.float64()))], [*names, "_part", "sums"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, kinds, strict=True)), pa.array([held], pa.list_(pa.float64()))], [*names, "sums"])

        for b in batches:
            for i in range(b.num_rows):
                own = tuple(b.column(c)[i].as_py() for c in range(len(names)))
                array = b.column(len(names) + 1)[i].values.to_numpy(zero_copy_only=False)
                if own == key:
                    held = merge(held, array)
                    continue
                if key is not None:
                    yield row()
                key, held = own, array
        if key is not None:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(keys).fields]
    parts = df.coalesce(TASKS).mapInArrow(first, f"{keys}, _part long, sums array<double>")
    return parts.repartition(*names).sortWithinPartitions(*names, "_part").mapInArrow(second, f"{keys}, sums array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column without nulls, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width) if len(flat) else np.zeros((0, width))


def _merge_moments(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Two tiles' count, means of their rows' and columns' variables, and centred products, as those of both."""
    ca, cb = a[0], b[0]
    total = ca + cb
    if not cb or not total:
        return a
    delta = b[1 : 1 + n + m] - a[1 : 1 + n + m]
    out = a + b
    out[1 : 1 + n + m] = a[1 : 1 + n + m] + delta * (cb / total)
    out[1 + n + m :] += np.outer(delta[:n], delta[n:]).ravel() * (ca * cb / total)
    return out


def moment_tiles(df: DataFrame, values: Column, width: int, by: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """(by, a, b, sums) of an array column of ``width`` numbers: for each pair of tiles a <= b of ``tile`` places the row count, both tiles' means and their centred products.

    Rows with a missing value are left out. One pass, and one merge of tasks' tiles; centred by the running
    mean, so that large values cost no digits.
    """
    by = by or []
    held = df.select(*by, values.alias("_v")).where(F.forall("_v", lambda x: x.isNotNull()))
    edges = [(i, min(width, i + tile)) for i in range(0, width, tile)]
    most = max(1, HELD // (8 * width * width))

    def sums(batches: Iterator[pa.RecordBatch]):
        states: dict[tuple, list] = {}

        def give():
            for key, (n, mean, m2) in states.items():
                for a, (i, j) in enumerate(edges):
                    for b, (k, e) in enumerate(edges[a:], a):
                        yield (*key, a, b), np.concatenate([[n], mean[i:j], mean[k:e], m2[i:j, k:e].ravel()])
            states.clear()

        for b in batches:
            x = matrix(b.column(len(by)), width)
            if by:
                keys = list(zip(*(c.to_pylist() for c in b.columns[: len(by)]), strict=True))
                places: dict[tuple, list[int]] = {}
                for i, key in enumerate(keys):
                    places.setdefault(key, []).append(i)
                groups = [(key, x[p]) for key, p in places.items()]
            else:
                groups = [((), x)] if len(x) else []
            for key, own in groups:
                for at in range(0, len(own), ROWS):
                    part = own[at : at + ROWS]
                    n, mean = len(part), part.mean(0)
                    centred = part - mean
                    m2 = centred.T @ centred
                    if key not in states and len(states) >= most:
                        yield from give()
                    if key not in states:
                        states[key] = [n, mean, m2]
                        continue
                    s = states[key]
                    delta, total = mean - s[1], s[0] + n
                    s[2] += m2 + np.outer(delta, delta) * (s[0] * n / total)
                    s[1] = s[1] + delta * (n / total)
                    s[0] = total
        yield from give()

    kinds = StructType([df.schema[c] for c in by])
    keys = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields), "a int", "b int"])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # The lengths of a tile's two sides follow from its array's: only the last tile is narrower, and it comes second.
        last = width - edges[-1][0]
        n, m = next((n, m) for n, m in ((tile, tile), (tile, last), (last, last)) if len(a) == (n + 1) * (m + 1))
        return _merge_moments(a, b, n, m)

    return summed(held, sums, merge, keys)


def moment_cells(df: DataFrame, columns: list[str] | str, width: int | None = None, by: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """(by, i, j, n, mean_i, mean_j, m2) for all places i <= j of ``columns``, or of one array column of ``width`` numbers.

    m2 is the sum of products of deviations from the means; that of the values themselves is m2 + n * mean_i * mean_j.
    """
    if isinstance(columns, str):
        require_columns(df, columns)
        values = F.transform(columns, no_nan)
    else:
        require_columns(df, *columns)
        values, width = F.array(*[no_nan(F.col(c)) for c in columns]), len(columns)
    by = by or []
    tile = min(tile, width)
    tiles = moment_tiles(df, values, width, by, tile)
    edges = [(i, min(width, i + tile)) for i in range(0, width, tile)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (i, j), (k, e) = (edges[b.column(len(by) + c)[r].as_py()] for c in (0, 1))
                s = b.column(len(by) + 2)[r].values.to_numpy(zero_copy_only=False)
                n, m = j - i, e - k
                row, col = np.divmod(np.arange(n * m), m)
                keep = row + i <= col + k
                row, col, m2 = row[keep], col[keep], s[1 + n + m :][keep]
                own = [pa.array([b.column(c)[r].as_py()] * len(row), b.column(c).type) for c in range(len(by))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(row + i, pa.int32()), pa.array(col + k, pa.int32()), pa.array(np.full(len(row), int(s[0]))), pa.array(s[1 : 1 + n][row]), pa.array(s[1 + n : 1 + n + m][col]), pa.array(m2)], [*by, "i", "j", "n", "mean_i", "mean_j", "m2"])

    keys = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return tiles.mapInArrow(cells, f"{keys}i int, j int, n long, mean_i double, mean_j double, m2 double")
