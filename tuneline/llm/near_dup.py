"""Near-duplicate documents by an LSH forest of MinHash signatures, links confirmed on full shingle sets.

Each distinct shingle set has one signature. The forest's trees are orders of the
signatures, each by its own hash values: neighbours in an order share a long prefix. A
region is what agrees in an order's first values. Small regions are compared whole, by
estimate. Regions that are too large are split at longer prefixes, as deep as each needs,
and dealt out by id where values run out; in them each row is compared with its neighbours
in the order and with medoids, which links families of copies cheaply.

Neighbours and medoids can miss a link, and a deeper prefix can part one, so regions with more
than one component get a second round. Those that weren't split are compared by estimate, which
leaves a forest of what it allows. For the others it is exact: linked sets share a shingle among
the rarest few of each. Rows meet by those shingles, counted over these rows and between
different components only, so boilerplate that many of them hold brings nobody together. Candidates
are confirmed on the full sets, blocks of documents side by side; only links leave a task, so
a dense region costs rows and not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.llm.common import table
from tuneline.session import materialize, require_columns

#: Orders, values that sort each of them, and values that the rows of a region share.
TREES, VALUES, PREFIX = 16, 6, 3
HASHES = TREES * VALUES
#: Rows of a region that are compared whole; rows beyond which a region is split deeper; rows taken at once.
WHOLE, SPLIT, CHUNK = 64, 2048, 4096
#: Regions to split that a broadcast may hold; beyond it they are joined by sort-merge.
BROADCAST = 50_000
#: Links confirmed together at most; documents, and shingles, of a block of the second round.
LINKS, BLOCK, BLOCK_SHINGLES = 2_000, 2_048, 2_000_000
#: Rows of a block in the second round, where only marks are compared.
SEATS = 1_024
#: Pairs for each row of a rare shingle's place that are confirmed one by one; beyond them the place's rows are confirmed side by side.
FEW = 8
#: Chance that the estimate misses a pair whose similarity is just enough.
MISS = 2e-6

_RNG = np.random.default_rng(85)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _STEP[1]
    x = (x ^ (x >> np.uint64(27))) * _STEP[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles; ``known`` remembers words' hashes."""
    import xxhash

    own = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    for w in set(own).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
    k = min(words, len(own))
    n = len(own) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = _mix(x * _STEP[0] + h[i : i + n])
    return np.unique(x)


def signature(found: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of hashes."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] * _A
        part += _B
        np.minimum(least, part.min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            n, keys, signs, marks = [], [], [], []
            for x in b.column(1):
                found = shingles(x.as_py(), words, known)
                n.append(len(found))
                if not len(found):
                    keys.append(None), signs.append(None), marks.append(None)
                    continue
                s = signature(found)
                keys.append(np.array([found.sum(), _mix(found * _STEP[0]).sum()], np.uint64).tobytes() + len(found).to_bytes(4, "little"))
                signs.append(s.astype(">u4").tobytes())
                marks.append((s & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, signs, marks))], ["id", "n_shingles", "set_key", "sign", "marks"])

    return run


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal marks of each row of ``a`` with each of ``b``."""
    out = np.empty((len(a), len(b)), np.float32)
    step = max(1, 4_000_000 // max(1, len(b) * HASHES))
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None] == b[None]).mean(2)
    return out


class _Region:
    """One region of an order, taken in chunks of CHUNK rows; one of up to ``whole`` rows is compared whole.

    Others only take pairs that are ``likely`` links; the second round sees to what else the estimate allows there.
    """

    def __init__(self, least: float, whole: int, likely: float):
        self.least, self.whole, self.likely = least, whole, likely
        self.medoids = np.zeros((0, HASHES), np.uint8)
        self.medoid_ids = np.zeros(0, np.int64)
        self.last = (np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint8))

    def all_pairs(self, ids: np.ndarray, marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        i, j = np.nonzero(np.triu(_agree(marks, marks) >= self.least, 1))
        return [(ids[i], ids[j])]

    def chunk(self, ids: np.ndarray, marks: np.ndarray, whole: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        if whole and len(ids) <= self.whole:
            return self.all_pairs(ids, marks)
        found = []
        near_ids, near = np.concatenate([self.last[0], ids]), np.concatenate([self.last[1], marks])
        hit = (near[1:] == near[:-1]).mean(1) >= self.likely
        found.append((near_ids[1:][hit], near_ids[:-1][hit]))
        self.last = (ids[-1:], marks[-1:])
        left = np.ones(len(ids), bool)
        if len(self.medoids):
            share = _agree(marks, self.medoids)
            best = share.argmax(1)
            left = share[np.arange(len(ids)), best] < self.likely
            found.append((ids[~left], self.medoid_ids[best[~left]]))
        poor = 0
        while left.sum() > self.whole and poor < 16:
            rows = np.flatnonzero(left)
            mode = np.array([np.bincount(c, minlength=256).argmax() for c in marks[rows].T], np.uint8)
            middle = rows[(marks[rows] == mode).mean(1).argmax()]
            own = rows[(marks[rows] == marks[middle]).mean(1) >= self.likely]
            found.append((ids[own], np.full(len(own), ids[middle])))
            left[own] = False
            poor += len(own) < 4
            self.medoids = np.concatenate([self.medoids, marks[middle][None]])
            self.medoid_ids = np.append(self.medoid_ids, ids[middle])
        # What no medoid is near is left to the second round.
        rest = np.flatnonzero(left)
        return [*found, *self.all_pairs(ids[rest], marks[rest])] if len(rest) <= self.whole else found


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, pa.RecordBatch]]:
    """Slices of sorted batches, each within one region, with whether a region begins and ends there; regions of one row are left out."""
    held: list[pa.RecordBatch] = []
    last, begun = None, True

    def size() -> int:
        return sum(x.num_rows for x in held)

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0)
        key = key.to_numpy()[:, None] if key.type == pa.int64() else np.frombuffer(b"".join(key.to_pylist()), np.uint8).reshape(b.num_rows, -1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        if last is not None and key[0].tobytes() != last:
            if size() > 1 or not begun:
                yield begun, True, held
            held, begun = [], True
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i:
                if size() > 1 or not begun:
                    yield begun, True, held
                held, begun = [], True
            for at in range(i, j, CHUNK):
                if size() >= CHUNK:
                    yield begun, False, held
                    held, begun = [], False
                held.append(b.slice(at, min(CHUNK, j - at)))
        last = key[-1].tobytes()
    if size() > 1 or not begun:
        yield begun, True, held


def _columns(held: list[pa.RecordBatch], *more: str) -> tuple[np.ndarray, ...]:
    t = pa.Table.from_batches(held)
    marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(t.num_rows, HASHES)
    return t.column("id").to_numpy(), marks, *(t.column(c).to_numpy() for c in more)


_PAIR = "a long, b long"


def _out(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.int64)]).astype(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _first_round(percent: int, least: float):
    """Candidate pairs; a row of a region that isn't compared whole also comes as a pair of itself."""

    def run(batches):
        region, gathered = _Region(least, WHOLE, percent / 100), []
        for begins, ends, held in _regions(batches):
            if begins:
                region = _Region(least, WHOLE, percent / 100)
            ids, marks = _columns(held)
            large = not (begins and ends and len(ids) <= WHOLE) or held[0].column("deep")[0].as_py()
            pairs = region.chunk(ids, marks, begins and ends)
            pairs = [(x[x != y], y[x != y]) for x, y in pairs]
            gathered += [*pairs, (ids, ids)] if large else pairs
            if sum(len(x) for x, _ in gathered) > 50_000:
                yield _out(gathered)
                gathered = []
        yield _out(gathered)

    return run


def _join_up(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the ends of all edges (i, j), and what they were joined with before, the same least label."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != label[label]).any():
            label[:] = label[label]


def _second_round(percent: int, least: float, few: int):
    """Pairs of different components that the estimate allows, among a place's rows; a forest of them (dense) where there are more than ``few`` for each row."""

    def run(batches):
        parts = []
        for begins, ends, held in _regions(batches):
            parts = held if begins else [*parts, *held]
            if not ends:
                continue
            ids, marks, component, block, size, short = _columns(parts, "component", "block", "size", "short")
            label, pairs, most = np.arange(len(ids)), [], few * len(ids)
            # Rows of one block meet in the place that has them alone.
            apart = block.min() != block.max()
            for at in range(0, len(ids), 512):
                for then in range(at, len(ids), CHUNK):
                    x, y = slice(at, at + 512), slice(then, then + CHUNK)
                    low, high = np.minimum(size[x, None], size[None, y]), np.maximum(size[x, None], size[None, y])
                    # The smaller of two linked sets has a common shingle in its short prefix.
                    open_ = (component[x, None] != component[None, y]) & (100 * low >= percent * high)
                    open_ &= (short[x, None] & (size[x, None] == low)) | (short[None, y] & (size[None, y] == low))
                    if apart:
                        open_ &= block[x, None] != block[None, y]
                    if open_.any():
                        i, j = np.nonzero(open_ & (_agree(marks[x], marks[y]) >= least))
                        _join_up(label, at + i, then + j)
                        most -= len(i)
                        pairs = [*pairs, (ids[at + i], ids[then + j])] if most >= 0 else []
            found = _out(pairs if most >= 0 else [(ids, ids[label])])
            yield found.append_column("dense", pa.array([most < 0] * found.num_rows, pa.bool_()))
        yield _out([]).append_column("dense", pa.array([], pa.bool_()))

    return run


def _sets(words: int):
    """The shingles of each text beside its columns."""

    def run(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            sets = [shingles(x, words, known).view(np.int64) for x in b.column("_text").to_pylist()]
            hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("component"), b.column("marks"), hashes], ["id", "component", "marks", "hashes"])

    return run


def _place(key: Column, low: Column, high: Column) -> Column:
    """Names of equal length for places: a key and the two blocks that meet."""
    return F.concat(*[F.unhex(F.lpad(F.hex(c), n, "0")) for c, n in ((key, 16), (low, 8), (high, 8))])


def rare_places(rows: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(place, id, marks, component, block, size, short): rows of different components that could be linked share a place. ``rows`` has id, component and marks.

    A set's shingles are ordered by how many of ``rows`` hold them, those of one component alone
    first. Linked sets of sizes m <= n share at least p n / 100, and 2 p m / (100 + p), of their
    shingles; so one is among the first n - that + 1 of the larger set and among the first
    m - that + 1 of the smaller, its short prefix. A place is a shingle that is in some row's
    short prefix; one of over SEATS rows is dealt into blocks that meet two by two.
    """
    held = rows.select("id", "component", "marks").hint("merge").join(docs.select(F.col("_id").alias("id"), "_text"), "id")
    sets = held.mapInArrow(_sets(words), "id long, component long, marks binary, hashes array<bigint>")
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("row"), "*"), "sets")
    flat = sets.select("row", "component", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    ends = [F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")]
    # Counts are written before their joins, so that a common shingle's rows can be split.
    shared = materialize(flat.groupBy("h").agg(*ends).where("low <> high").select("h", "n"), "shared")
    ranked = flat.join(shared, "h").groupBy("row", "component", "size").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("common"))
    alone = F.col("size") - F.size("common")
    first = lambda least: F.greatest(F.col("size") - F.ceil(least) + 1 - alone, F.lit(0)).cast("int")
    long, short = first(F.lit(percent) * F.col("size") / 100), first(F.lit(2 * percent) * F.col("size") / (100 + percent))
    taken = F.transform(F.slice("common", 1, long), lambda x, i: F.struct(x["h"].alias("h"), (i < short).alias("short")))
    picked = materialize(ranked.select("row", "component", "size", F.inline(taken)), "rare")
    meet = picked.groupBy("h").agg(*ends, F.max("short").alias("any")).where("low <> high and any")
    meet = materialize(meet.select("h", F.ceil(F.col("n") / SEATS).cast("int").alias("blocks")), "meet")
    seats = picked.join(meet, "h").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    seats = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = _place(F.col("h"), F.least("block", "other"), F.greatest("block", "other"))
    return seats.select(place.alias("place"), "row", "block", "size", "short").join(sets.select("row", "id", "marks", "component"), "row").select("place", "id", "marks", "component", "block", "size", "short")


def _confirm_blocks(words: int, percent: int, least: float):
    """Links between different components among the documents of two blocks (or one), as many as join them up."""

    def links(rows: list[tuple], known: dict[bytes, int]) -> pa.RecordBatch:
        side = np.array([r[1] for r in rows])
        ids, parts = [r[2] for r in rows], np.array([r[3] for r in rows])
        marks = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), HASHES)
        sets = [shingles(r[5], words, known) for r in rows]
        size = np.array([len(x) for x in sets])
        names, label = np.unique(parts, return_inverse=True)
        label, up = label.astype(np.int64), np.arange(len(names))
        first, second = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        a, b = [], []
        for at in range(0, len(first), 512):
            rows_ = first[at : at + 512]
            open_ = up[label[rows_]][:, None] != up[label[second]][None]
            open_ &= 100 * np.minimum(size[rows_][:, None], size[second][None]) >= percent * np.maximum(size[rows_][:, None], size[second][None])
            if not open_.any():
                continue
            i, j = np.nonzero(open_ & (_agree(marks[rows_], marks[second]) >= least))
            for x, y in zip(rows_[i].tolist(), second[j].tolist(), strict=True):
                if up[label[x]] == up[label[y]]:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a.append(ids[x]), b.append(ids[y])
                    _join_up(up, label[[x]], label[[y]])
        return _out([(np.array(a, np.int64), np.array(b, np.int64))])

    def run(batches):
        known: dict[bytes, int] = {}
        rows: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[0][0] != r[0]:
                    yield links(rows, known)
                    rows = []
                rows.append(r)
        if rows:
            yield links(rows, known)

    return run


def _confirm(words: int, percent: int):
    """Links among the documents of a block, whose rows lie together."""

    def links(sets: dict[int, list[np.ndarray]], asked: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        a, b = [], []
        for x, others in asked:
            for y in others:
                for s in sets[x]:
                    if any(100 * (both := len(np.intersect1d(s, t, assume_unique=True))) >= percent * (len(s) + len(t) - both) for t in sets.get(y, ())):
                        a.append(x), b.append(y)
                        break
        return _out([(np.array(a, np.int64), np.array(b, np.int64))])

    def run(batches):
        known: dict[bytes, int] = {}
        block, sets, asked = None, {}, []
        for b in batches:
            for own, doc, partners, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != block:
                    if asked:
                        yield links(sets, asked)
                    block, sets, asked = own, {}, []
                sets.setdefault(doc, []).append(shingles(text, words, known))
                if partners:
                    asked.append((doc, partners))
        yield links(sets, asked)

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, signs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. ``signs`` has id and n_shingles.

    Pairs of neighbouring documents meet in one block, named by the smallest neighbour's
    neighbour; a block of more than LINKS pairs, or BLOCK_SHINGLES shingles, is dealt out by the endpoint with fewer
    partners, so that a hub's set travels to each part and no part grows.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree")), "near")
    # A document's shingles count in each of its pairs by their share, and so once where its pairs lie in one block.
    near = near.join(signs.select(F.col("id").alias("a"), "n_shingles"), "a").select("a", "label", "degree", (F.col("n_shingles") / F.col("degree")).alias("weight"))
    own, other = near.select("a", F.col("label").alias("la"), F.col("degree").alias("da"), F.col("weight").alias("wa")), near.select(F.col("a").alias("b"), F.col("label").alias("lb"), F.col("degree").alias("db"), F.col("weight").alias("wb"))
    low_is_a = F.expr("da < db or (da = db and a < b)")
    placed = pairs.join(own, "a").join(other, "b").select(F.least("la", "lb").alias("block"), F.when(low_is_a, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(low_is_a, F.col("b")).otherwise(F.col("a")).alias("high"), (F.col("wa") + F.col("wb")).alias("weight"))
    # Both sides of the next join are written, so that the rows of a large block can be split.
    placed = materialize(placed, "placed")
    heavy = F.ceil(F.greatest(F.count(F.lit(1)) / LINKS, F.sum("weight") / BLOCK_SHINGLES))
    large = materialize(placed.groupBy("block").agg(heavy.alias("parts")).where("parts > 1"), "heavy")
    placed = placed.join(large, "block", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("low"), "parts")).otherwise(0))
    place = F.concat_ws(":", "block", "part").alias("place")
    asked = placed.groupBy(place, F.col("low").alias("doc")).agg(F.collect_list("high").alias("partners"))
    rest = placed.select(place, F.col("high").alias("doc")).distinct().withColumn("partners", F.lit(None).cast("array<bigint>"))
    seats = asked.unionByName(rest).groupBy("place", "doc").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    rows = seats.hint("merge").join(docs.select(F.col("_id").alias("doc"), "_text"), "doc").select("place", "doc", "partners", "_text")
    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(_confirm(words, percent), _PAIR).distinct()


def confirmed_in_blocks(forest: DataFrame, signs: DataFrame, docs: DataFrame, words: int, percent: int, least: float) -> DataFrame:
    """Links among documents that ``forest`` connects. ``signs`` has id, n_shingles, marks and component.

    A connected part of over BLOCK documents, or BLOCK_SHINGLES shingles, is dealt into blocks;
    every two of them meet once, so that no task holds more than two.
    """
    part = components(forest).withColumnRenamed("component", "part")
    rows = signs.join(part, "id")
    weight = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    rows = rows.join(rows.groupBy("part").agg(F.ceil(weight).cast("int").alias("blocks")), "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    seats = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seats = seats.select(F.concat_ws(":", "part", F.least("block", "other"), F.greatest("block", "other")).alias("place"), "block", "id", "component", "marks")
    held = seats.hint("merge").join(docs.select(F.col("_id").alias("id"), "_text"), "id").select("place", "block", "id", "component", "marks", "_text")
    return held.repartition("place").sortWithinPartitions("place").mapInArrow(_confirm_blocks(words, percent, least), _PAIR).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. Labels pass to neighbours and jump to their label's label until none changes."""
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        low = both.join(label.select(F.col("a").alias("b"), F.col("label").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        low = label.join(low, "a").select("a", "label", F.least("label", "seen").alias("low"))
        jump = label.select(F.col("a").alias("low"), F.col("label").alias("far"))
        new = materialize(low.join(jump, "low").select("a", F.col("label").alias("old"), F.least("low", "far").alias("label")), "labels")
        label = new.select("a", "label")
        if new.where("old <> label").isEmpty():
            return label.select(F.col("a").alias("id"), F.col("label").alias("component"))


def least_agreement(percent: int) -> float:
    """The least share of agreeing marks at which a pair is looked at: one of just ``percent`` agrees less with a chance of MISS at most."""
    p, chance, n = percent / 100, 0.0, 0
    while (chance := chance + math.comb(HASHES, n) * p**n * (1 - p) ** (HASHES - n)) <= MISS:
        n += 1
    return (n - 0.5) / HASHES


def _orders(signs: DataFrame, *more: str) -> DataFrame:
    """A row for each tree, with its region (a hash of the tree and the first PREFIX values) and its place in the order."""
    tree = signs.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    start = f"tree * {4 * VALUES} + 1"
    return tree.select(F.expr(f"xxhash64(tree, substring(sign, {start}, {4 * PREFIX}))").alias("region"), F.expr(f"substring(sign, {start}, {4 * VALUES})").alias("value"), "id", *more)


def _joined(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """``rows`` with what ``few``, a written table by region, says; broadcast only if it is small."""
    return rows.join(F.broadcast(few) if few.limit(BROADCAST + 1).count() <= BROADCAST else few.hint("merge"), "region", how)


def depths(signs: DataFrame) -> DataFrame | None:
    """(region, depth, parts) of regions of over SPLIT rows; None if there is none.

    The depth is the shortest prefix all of whose parts are small enough; where values run
    out, parts is how many ways rows of equal values are dealt.
    """
    rows = _orders(signs)
    large = materialize(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("region"), "large")
    if large.isEmpty():
        return None
    values = materialize(_joined(rows, large, "inner").groupBy("region", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    sizes = None
    for depth in range(PREFIX + 1, VALUES + 1):
        part = values.groupBy("region", F.substring("value", 1, 4 * depth).alias("v")).agg(F.sum("n").alias("n"))
        part = part.groupBy("region").agg(F.max("n").alias("most")).withColumn("depth", F.lit(depth))
        sizes = part if sizes is None else sizes.unionByName(part)
    found = sizes.groupBy("region").agg(F.min(F.when(F.col("most") <= SPLIT, F.col("depth"))).alias("enough"), F.min("most").alias("most"))
    parts = F.when(F.col("enough").isNull(), F.ceil(F.col("most") / SPLIT)).otherwise(1).cast("int")
    return materialize(found.select("region", F.coalesce("enough", F.lit(VALUES)).alias("depth"), parts.alias("parts")), "depths")


def forest_pairs(signs: DataFrame, percent: int, least: float) -> DataFrame:
    """Candidate pairs (a, b) of the forest, and (a, a) for each row of a region that isn't compared whole."""
    rows, deeper = _orders(signs, "marks"), depths(signs)
    if deeper is None:
        rows = rows.withColumn("deep", F.lit(False))
    else:
        key = F.when(F.col("depth").isNull(), F.col("region")).otherwise(F.xxhash64("region", F.expr("substring(value, 1, 4 * depth)"), F.pmod(F.xxhash64("id"), F.col("parts"))))
        rows = _joined(rows, deeper, "left").select(key.alias("region"), "value", "id", "marks", F.col("depth").isNotNull().alias("deep"))
    sorted_ = rows.repartition("region").sortWithinPartitions("region", "value").drop("value")
    return materialize(sorted_.mapInArrow(_first_round(percent, least), _PAIR).distinct(), "pairs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id reachable by links) and kept (it is that document).

    Two documents are linked if 100 * intersection >= percent * union of their sets of word
    shingles (A-Z lower-cased). A text with fewer words is one shingle; an empty or null one
    has none and is linked with nothing, as is a row without id (component null, kept). Rows
    with one id are one document in links. Texts are read whole, however long. An empty table gives
    an empty table. Ids are integers; other columns are ignored, whatever their names.
    """
    require_columns(docs, id_col, text_col)
    least = least_agreement(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signed = materialize(docs.mapInArrow(_sign(words), "id long, n_shingles long, set_key binary, sign binary, marks binary"), "signed")
    real = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    # Written before the join, so that the rows of a common set can be split.
    classes = materialize(signed.where(real).groupBy("set_key").agg(F.min("id").alias("first")), "classes")
    tagged = signed.where(real).join(classes, "set_key")
    first = F.col("id") == F.col("first")
    tagged = materialize(tagged.select("id", "n_shingles", "first", F.when(first, F.col("sign")).alias("sign"), F.when(first, F.col("marks")).alias("marks")), "tagged")
    signs = tagged.where(first).select("id", "n_shingles", "sign", "marks")
    pairs = forest_pairs(signs, percent, least)
    links = materialize(confirmed(pairs.where("a <> b"), docs, signs, words, percent), "links")
    group = components(links)
    dense = pairs.where("a = b").select(F.col("a").alias("id"))
    if not dense.isEmpty():
        again = signs.join(dense.distinct(), "id").join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))
        again = materialize(again, "dense")
        # Regions of one component, as a family of copies mostly is, are done.
        rows = _orders(again, "component").drop("value")
        mixed = rows.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where(f"low <> high and n > {WHOLE}")
        mixed = materialize(mixed.select("region", "n"), "mixed")
        own, zero = _joined(_orders(again, "component", "marks", "n_shingles"), mixed.where(f"n <= {SPLIT}"), "inner"), F.lit(0)
        own = own.select(_place(F.col("region"), zero, zero).alias("place"), "id", "marks", "component", zero.alias("block"), F.col("n_shingles").alias("size"), F.lit(True).alias("short"))
        parted = mixed.where(f"n > {SPLIT}").select("region")
        rounds = [(own, 0)]
        if not parted.isEmpty():
            left = _joined(rows, parted, "inner").select("id").distinct()
            rounds.append((rare_places(materialize(again.join(left, "id"), "again"), docs, words, percent), FEW))
        found = None
        for places, most in rounds:
            part = places.repartition("place").sortWithinPartitions("place").mapInArrow(_second_round(percent, least, most), f"{_PAIR}, dense boolean")
            found = part if found is None else found.unionByName(part)
        found = materialize(found.where("a <> b").distinct(), "found")
        few, forest = (found.where(c).select("a", "b").distinct() for c in ("not dense", "dense"))
        new = links.limit(0)
        if not few.isEmpty():
            new = materialize(confirmed(few, docs, signs, words, percent), "links")
        if not forest.isEmpty():
            new = new.unionByName(materialize(confirmed_in_blocks(forest, again, docs, words, percent, least), "links"))
        if not new.isEmpty():
            group = components(links.unionByName(new))
    group = group.select(F.col("id").alias("first"), "component")
    done = tagged.select("id", "n_shingles", "first").join(group, "first", "left").select("id", "n_shingles", F.coalesce("component", "first").alias("component_id"))
    alone = signed.where(~F.coalesce(real, F.lit(False))).select("id", "n_shingles", F.col("id").alias("component_id"))
    out = done.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("id", id_col)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of the smallest id (rows that share an id stay together)."""
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(id_col).distinct()
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(*docs.columns)
