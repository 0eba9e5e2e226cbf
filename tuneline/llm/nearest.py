"""Approximate nearest neighbours: a navigable small-world graph for each shard, shard results merged.

Equal vectors form one node that knows its smallest ids, so that a common vector costs one
node. Nodes of one length and about one norm share shards, since a graph finds large inner
products well where norms are close. Every node is in one shard's graph; every query searches
all shards of its length, and their best are merged. Scores are exact, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneline.llm import hnsw
from tuneline.llm.common import table
from tuneline.session import materialize, require_columns

#: Most nodes of a shard, and bytes of their vectors. Most queries that a shard's arrays are copied for, and the least where there are cores to fill.
SHARD_NODES, SHARD_BYTES, BLOCK, LEAST_BLOCK = 25_000, 32 << 20, 200_000, 512
#: Ratio of norms between the bands that shards keep to. Bands of together no more than SMALL nodes, and within NEAR steps, share one.
BAND, SMALL, NEAR = 1.25, 1_000, 3


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the vectors that take part: not null, empty or zero, and finite."""
    require_columns(vectors, id_col, vector_col)
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vector"))


def _band(v: Column) -> Column:
    """The norm's logarithm in steps of BAND; scaled by the largest component, so that no square overflows."""
    top = F.array_max(F.transform(v, F.abs))
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / top) * (x / top))
    return F.rint((F.log(top) + F.log(squares) / 2) / math.log(BAND)).cast("int")


def deal(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(length, band, first shard, shards) for (length, band, nodes): small neighbouring bands together, large ones in several shards."""
    runs: list[list] = []
    for length, band, n in sorted(counts):
        if runs and runs[-1][0] == length and runs[-1][2] + n <= SMALL and band - runs[-1][1][0] <= NEAR:
            runs[-1][1].append(band)
            runs[-1][2] += n
        else:
            runs.append([length, [band], n])
    out, first = [], 0
    for length, bands, n in runs:
        shards = -(-n // max(1, min(SHARD_NODES, SHARD_BYTES // (8 * length))))
        out += [(length, b, first, shards) for b in bands]
        first += shards
    return out


def build_index(rows: DataFrame, k: int) -> DataFrame:
    """One row a shard: length of its vectors, ids (flat, up to k + 1 smallest of each node), where each node's ids begin, vectors, the graph's flat arrays, and the beam that finds enough of a sample's nearest.

    One row of counts for each length and band of norms reaches the driver.
    """
    # The limit on ranks goes before the shuffle, so that copies of a common vector don't travel.
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= k + 1)
    nodes = ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = materialize(nodes.withColumns({"length": F.size("vector"), "band": _band(F.col("vector"))}), "nodes")
    plan = deal([tuple(r) for r in nodes.groupBy("length", "band").count().collect()])
    shards = max((first + n for _, _, first, n in plan), default=0)
    dealt = F.broadcast(rows.sparkSession.createDataFrame(plan, "length int, band int, first int, shards int"))
    shard = (F.col("first") + F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("shards"))).cast("int")
    placed = nodes.join(dealt, ["length", "band"]).select(shard.alias("shard"), "length", "vector", "ids")

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("ids").to_pylist()
        order = np.argsort([x[0] for x in ids], kind="stable")
        vectors = group.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        ids = [ids[i] for i in order]
        graph = hnsw.build(hnsw.linked(vectors))
        flat = {"ids": np.array([i for x in ids for i in x], np.int64), "starts": np.cumsum([0, *map(len, ids)]), "vectors": vectors}
        names = sorted(graph)
        row = {"shard": group.column("shard")[0].as_py(), "length": vectors.shape[1], **{n: x.tobytes() for n, x in flat.items()}, "names": names, "arrays": [graph[n].tobytes() for n in names], "beam": hnsw.beam_for(vectors, graph, k + 1)}
        return pa.Table.from_pylist([row], _INDEX)

    apart = placed.repartition(max(1, min(shards, 10_000)), "shard")
    return materialize(apart.groupBy("shard").applyInArrow(build, "shard int, length int, ids binary, starts binary, vectors binary, names array<string>, arrays array<binary>, beam int"), "index")


_INDEX = pa.schema([("shard", pa.int32()), ("length", pa.int32()), ("ids", pa.binary()), ("starts", pa.binary()), ("vectors", pa.binary()), ("names", pa.list_(pa.string())), ("arrays", pa.list_(pa.binary())), ("beam", pa.int32())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class _Shard:
    """A shard's arrays, read once for all the queries that follow its row."""

    def __init__(self, row: dict):
        self.ids, self.starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.starts) - 1, -1)
        held = {n: np.frombuffer(x, np.int32) for n, x in zip(row["names"], row["arrays"], strict=True)}
        self.graph = {n: x if n == "entry" else x.reshape(len(self.vectors), -1) for n, x in held.items()}
        # Inner products of single precision choose; their scale doesn't matter, so that it may be brought near 1.
        self.points = (self.vectors / np.abs(self.vectors).max()).astype(np.float32)
        self.beam = row["beam"]

    def find(self, own: list[int], asked: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        near, _ = hnsw.search(self.points, self.graph, hnsw.directions(asked), k + 1, self.beam)
        out: list[tuple[int, int, float]] = []
        for q, v, nodes in zip(own, asked, near, strict=True):
            nodes = nodes[nodes >= 0]
            scores = (self.vectors[nodes] * v).sum(1)
            hits = [(-s, i) for s, n in zip(scores.tolist(), nodes.tolist(), strict=True) for i in self.ids[self.starts[n] : self.starts[n + 1]].tolist() if i != q]
            out += [(q, i, -s) for s, i in sorted(hits)[:k]]
        return out


def search_index(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, never the query's own id; ``queries`` has id and vector.

    A shard's row comes before its queries and is read once for a block of up to BLOCK of
    them, so the copies of shards stay a small share of what is shuffled.
    """
    spark, n = index.sparkSession, queries.count()
    shards = index.count()
    # Small tables have blocks enough for the cores.
    spread = -(-2 * spark.sparkContext.defaultParallelism // max(1, shards))
    blocks = max(1, -(-n // BLOCK), min(spread, n // LEAST_BLOCK))
    held = index.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "id": F.lit(None).cast("long"), "vector": F.lit(None).cast("array<double>")})
    asked = queries.withColumns({"length": F.size("vector"), "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")})
    asked = asked.join(index.select("length", "shard").hint("shuffle_hash" if shards > 100_000 else "broadcast"), "length")
    rows = held.unionByName(asked, allowMissingColumns=True).repartition(max(1, min(shards * blocks, 10_000)), "shard", "block")
    rows = rows.sortWithinPartitions("shard", "block", F.col("id").asc_nulls_first())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard | None = None
        for b in batches:
            ids = b.column("id")
            is_shard = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
            for at, end in zip([0, *(is_shard + 1).tolist()], [*is_shard.tolist(), b.num_rows], strict=True):
                if at and at - 1 in is_shard:
                    shard = _Shard(b.slice(at - 1, 1).to_pylist()[0])
                for i in range(at, end, 1024):
                    part = b.slice(i, min(1024, end - i))
                    vectors = part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1)
                    found = shard.find(part.column("id").to_pylist(), vectors, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True) if found else ((), (), ()), _FOUND, strict=True)], schema=_FOUND)

    found = rows.mapInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each usable vector that ``is_query`` picks, its k nearest others of its length by inner product, ties to the smaller id.

    Null, empty, zero and non-finite vectors take no part, and vectors of different length are
    never compared; repeated vectors are all candidates; with fewer than k candidates all are
    returned; an empty table gives an empty table. Vectors may have any length: shards of wide ones have fewer nodes. Other columns are ignored, whatever their names.
    """
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    return search_index(build_index(rows, k), rows.where(is_query), k)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
