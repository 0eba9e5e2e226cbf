"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (their pattern). A flow
routes the patterns' words to the sources' quotas; the first pass over a pattern is free
and each further repeat costs more, so repeats are used only where quotas ask for them.
Inside a pattern the documents are taken in the order of a seeded hash, so that reruns
agree whatever the partitioning. Only sums by pattern and by hash bucket reach the driver.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneline.llm.common import count_words, table, unused
from tuneline.session import materialize, require_columns

#: Sources weigh so, in code point order, over and over.
WEIGHTS = (5, 2, 1)
#: Words of the mix over words there are, and the most often that a document may be taken.
SHARE, REPEATS = 1.5, 2
SEED = 17
#: Bounds of what the driver gets: rows, one for each membership pattern, and those of sources that share documents, which the flow decides.
MAX_PATTERNS, MAX_SHARED = 1_000_000, 20_000
#: Patterns that a broadcast may hold; beyond it they are joined by sort-merge.
BROADCAST = 100_000


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> dict[str | None, float]:
    """Target words by source: by weight, at most ``repeats`` times the size, the excess reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = share * sum(sizes.values()), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > repeats * sizes[s]]
        if not above:
            return out | {s: level * weight[s] for s in free}
        for s in above:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


class _Flow:
    """A network of arcs with capacities and costs; arc e goes back as e ^ 1."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.height = [0] * nodes

    def arc(self, u: int, v: int, cap: int, cost: int) -> int:
        for a, b, c, w in ((u, v, cap, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def lift(self, start: int, sink: int) -> bool:
        """Raise the heights by the distances from ``start``; whether the sink can be reached."""
        to, cap, cost, height = self.to, self.cap, self.cost, self.height
        far, heap = [math.inf] * len(height), [(0, start)]
        far[start] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in self.out[u]:
                if cap[e] > 0 and (n := d + cost[e] + height[u] - height[to[e]]) < far[to[e]]:
                    far[to[e]] = n
                    heapq.heappush(heap, (n, to[e]))
        if far[sink] == math.inf:
            return False
        self.height = [h + min(f, far[sink]) for h, f in zip(height, far, strict=True)]
        return True

    def fill(self, start: int, sink: int) -> bool:
        """Send what fits along cheapest arcs, by numbers of arcs from ``start``; whether anything did."""
        to, cap, cost, height = self.to, self.cap, self.cost, self.height
        level = [-1] * len(height)
        level[start], line = 0, [start]
        for u in line:
            for e in self.out[u]:
                v = to[e]
                if cap[e] > 0 and level[v] < 0 and cost[e] + height[u] == height[v]:
                    level[v] = level[u] + 1
                    line.append(v)
        if level[sink] < 0:
            return False
        at, path, u = [0] * len(height), [], start
        while True:
            if u == sink:
                most = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= most
                    cap[e ^ 1] += most
                back = next(i for i, e in enumerate(path) if cap[e] == 0)
                u, path = to[path[back] ^ 1], path[:back]
            while at[u] < len(self.out[u]):
                e = self.out[u][at[u]]
                v = to[e]
                if cap[e] > 0 and level[v] == level[u] + 1 and cost[e] + height[u] == height[v]:
                    path.append(e)
                    u = v
                    break
                at[u] += 1
            else:
                if not path:
                    return True
                u = to[path.pop() ^ 1]
                at[u] += 1


def route(supply: list[int], members: list[tuple[int, ...]], quota: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Cheapest flow of pattern words to source quotas; repeat number k of a pattern costs k a word.

    Cheapest paths with heights, over start -> pattern (one arc for each repeat) -> its sources ->
    sink; all paths of one cost and length are filled together. Returns, for each pattern, words
    by source index.
    """
    p, s = len(supply), len(quota)
    start, sink, first = 0, 1 + p + s, 1 + p
    net, own = _Flow(p + s + 2), []
    for i, n in enumerate(supply):
        for k in range(repeats):
            net.arc(start, 1 + i, n, k)
        own.append({j: net.arc(1 + i, first + j, repeats * n, 0) for j in members[i]})
    for j, q in enumerate(quota):
        net.arc(first + j, sink, q, 0)
    while net.lift(start, sink):
        while net.fill(start, sink):
            pass
    return [{j: net.cap[e ^ 1] for j, e in arcs.items() if net.cap[e ^ 1]} for arcs in own]


def flows(supply: list[int], members: list[tuple[int, ...]], quota: list[int], repeats: int = REPEATS) -> list[int]:
    """Words taken of each pattern, by route().

    Of more than MAX_SHARED patterns only those are routed whose sources share documents: the flow to any other source
    is its quota, as far as repeats reach, in closed form.
    """
    if len(members) <= MAX_SHARED:
        return [sum(flow.values()) for flow in route(supply, members, quota, repeats)]
    patterns = Counter(j for own in members for j in own)
    shared = {j for own in members for j in own if len(own) > 1 or patterns[j] > 1}
    mixed = [i for i, own in enumerate(members) if shared.intersection(own)]
    if len(mixed) > MAX_SHARED:
        raise ValueError(f"over {MAX_SHARED} membership patterns of sources that share documents; merge sources first")
    taken = [min(quota[own[0]], repeats * n) if own else 0 for n, own in zip(supply, members, strict=True)]
    numbers = {j: k for k, j in enumerate(sorted(shared))}
    routed = route([supply[i] for i in mixed], [tuple(numbers[j] for j in members[i]) for i in mixed], [quota[j] for j in numbers], repeats)
    for i, flow in zip(mixed, routed, strict=True):
        taken[i] = sum(flow.values())
    return taken


def seed_key(doc_id: Column, seed: int = SEED) -> Column:
    """The order in which a pattern's documents are taken."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _few(df: DataFrame, n: int) -> DataFrame:
    """``df``, of up to ``n`` rows, for a join: broadcast if that is few."""
    return F.broadcast(df) if n <= BROADCAST else df.hint("merge")


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, dict]:
    """How much of each pattern is taken: a small table, and the sources' sizes and targets.

    ``sized`` has pattern (array of sources, a source may be null), key (hash) and size. The
    table has a row for each pattern: pattern, full (copies of every document) and edge (documents
    with a smaller or equal key get one copy more; null: none).
    """
    spark = sized.sparkSession
    by_bucket = materialize(sized.withColumn("bucket", F.substring("key", 1, 3)).groupBy("pattern", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    rows = by_bucket.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns; merge sources first")
    names = sorted({s for r in rows for s in r["pattern"]}, key=lambda s: (s is None, s or ""))
    sizes, number = dict.fromkeys(names, 0), {s: i for i, s in enumerate(names)}
    for r in rows:
        for s in set(r["pattern"]):
            sizes[s] += r["words"]
    goal = targets(sizes, weights, share, repeats)
    found = flows([r["words"] for r in rows], [tuple(number[s] for s in dict.fromkeys(r["pattern"])) for r in rows], [round(goal[s]) for s in names], repeats)
    schema = f"pattern {sized.schema['pattern'].dataType.simpleString()}, full int, rest long"
    asked = []
    for r, taken in zip(rows, found, strict=True):
        full = min(repeats, taken // r["words"]) if r["words"] else 0
        asked.append((list(r["pattern"]), full, taken - full * r["words"]))
    plan = spark.createDataFrame(asked, schema)
    # The bucket in which the rest of a pattern's flow ends, then the key inside it.
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = F.expr("l.pattern <=> r.pattern")
    edge = (
        by_bucket.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .alias("l").join(_few(plan, len(asked)).alias("r"), same).select("l.*", "rest")
        .where((F.col("rest") > 0) & (F.col("start") <= F.col("rest")) & (F.col("start") + F.col("words") >= F.col("rest")))
    )
    inside = Window.partitionBy("pattern", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    near = (
        sized.alias("l").join(_few(edge, len(asked)).alias("r"), F.expr("l.pattern <=> r.pattern and substring(l.key, 1, 3) = r.bucket"))
        .select("l.pattern", "bucket", "key", "size", "start", "rest")
        .groupBy("pattern", "bucket", "key", "start", "rest").agg(F.sum("size").alias("size"))
        .withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )
    # A document belongs to the rest if more than half of it does; where a bucket has none, its lower bound.
    ends = near.groupBy("pattern").agg(F.max(F.when(2 * F.col("start") + F.col("size") < 2 * F.col("rest"), F.col("key"))).alias("inner"), F.min("bucket").alias("floor"))
    plan = plan.alias("l").join(ends.alias("r"), same, "left").select("l.*", F.when(F.col("rest") > 0, F.coalesce("inner", "floor")).alias("edge")).drop("rest")
    return materialize(plan.coalesce(1), "mix-plan"), {s: (sizes[s], goal[s]) for s in names}


def take(df: DataFrame, plan: DataFrame, pattern: Column, key: Column, out: str = "copies") -> DataFrame:
    """``df`` with ``out``, how often each document is taken; no shuffle where the plan, a row for each pattern, is small."""
    p, k = unused(df, "_pattern", "_key")
    held = df.withColumns({p: pattern, k: key}).alias("l")
    joined = held.join(_few(plan, plan.limit(BROADCAST + 1).count()).alias("r"), F.col(f"l.{p}").eqNullSafe(F.col("r.pattern")), "left")
    copies = F.coalesce(F.col("r.full"), F.lit(0)) + F.when(F.col(f"l.{k}") <= F.col("r.edge"), 1).otherwise(0)
    return joined.select("l.*", copies.alias(out)).drop(p, k)


def measured(docs: DataFrame, pattern: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    require_columns(docs, id_col, text_col)
    return docs.select(pattern.alias("pattern"), seed_key(F.col(id_col)).alias("key"), count_words(F.col(text_col)).alias("size"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with its columns unchanged.

    ``source_col`` is a string, or an array of strings where a document lies in several
    sources. Null sources form a source of their own, null and empty texts have size 0, long
    texts count whole, and an empty table gives an empty table. Rows that share an id are taken alike.
    """
    pattern = _pattern(docs, source_col)
    plan, _ = plan_mix(materialize(measured(docs, pattern, id_col, text_col), "mix-sizes"))
    times, nth = unused(docs, "_times", "_nth")
    taken = take(docs, plan, pattern, seed_key(F.col(id_col)), times).where(F.col(times) > 0)
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times, nth)


def _pattern(docs: DataFrame, source_col: str) -> Column:
    c = F.col(source_col)
    return F.array_sort(F.array_distinct(c)) if docs.schema[source_col].dataType.typeName() == "array" else F.array(c)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = F.array("source")
    sized = materialize(docs.select("doc_id", own.alias("pattern"), seed_key(F.col("doc_id")).alias("key"), count_words(F.col("text")).alias("size")), "mix-sizes")
    plan, goal = plan_mix(sized.drop("doc_id"))
    facts = spark.createDataFrame([([s], n, t) for s, (n, t) in goal.items()] or [], "pattern array<string>, source_size long, target double")
    taken = take(sized, plan, F.col("pattern"), F.col("key")).alias("l").join(_few(facts, len(goal)).alias("r"), F.expr("l.pattern <=> r.pattern"), "left")
    return taken.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), F.get("l.pattern", F.lit(0)).alias("source"), "copies")


OP9_SQL = r"""
with d as (
  select doc_id, source, md5(concat('17-', coalesce(cast(doc_id as varchar), ''))) as key,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 as turn from d group by source),
w as (select *, [5, 2, 1][turn + 1] as weight, 2.0 * source_size / [5, 2, 1][turn + 1] as ratio from s),
c as (  -- sources up to this one, by how soon they fill, are full; the others share what is left
  select *, sum(2.0 * source_size) over (order by ratio, source nulls last rows unbounded preceding) as filled,
         coalesce(sum(weight) over (order by ratio, source nulls last rows between 1 following and unbounded following), 0) as open_weight,
         1.5 * (select sum(source_size) from s) as budget
  from w),
f as (select max(case when filled + open_weight * ratio <= budget then ratio end) as full_to from c),
l as (select (max(budget) - coalesce(sum(case when ratio <= full_to then 2.0 * source_size end), 0)) / sum(case when full_to is null or ratio > full_to then weight end) as level from c, f),
t as (select source, source_size, case when ratio <= full_to then 2.0 * source_size else cast(level as double) * weight end as target from c, f, l),
q as (select *, cast(round_even(target, 0) as bigint) as quota, case when source_size = 0 then 0 else least(2, cast(round_even(target, 0) as bigint) // source_size) end as full_copies from t),
k as (select source, key, sum(size) as key_size from d group by source, key),
o as (select *, coalesce(sum(key_size) over (partition by source order by key rows between unbounded preceding and 1 preceding), 0) as start_at from k)
select d.doc_id, d.size, q.source_size, round(cast(q.target as double), 6) as target,
       cast(d.size * (full_copies + case when quota - full_copies * source_size > 0 and 2 * start_at + key_size < 2 * (quota - full_copies * source_size) then 1 else 0 end) as bigint) as taken,
       d.source, cast(full_copies + case when quota - full_copies * source_size > 0 and 2 * start_at + key_size < 2 * (quota - full_copies * source_size) then 1 else 0 end as integer) as copies
from d join q on d.source is not distinct from q.source join o on d.source is not distinct from o.source and d.key = o.key
"""
