"""Ranked lexical search: postings with range-maximum tables, searched best interval first.

``build_index`` turns documents into blocks of bounded size. A block has its documents in order of
their ids and a posting list for each of its terms; a row of the index is one posting list, so reading a
term's postings everywhere is a join. ``search`` takes the postings of the queries' terms, block
by block: each posting has an impact (what it adds to a score), and a sparse table answers which posting of any
range has most. The sum of a query's range maxima bounds every document between two places. The
most promising interval is split at the document of greatest impact, which gets its exact score; intervals
that can't reach the tenth best found so far are given up, short ones are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType
from pyspark.sql.window import Window

from tuneline.llm.common import ascii_lower, table
from tuneline.session import materialize, require_columns

#: Documents a query gets.
TOP = 10
#: Documents and words of a block of the index; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_WORDS = 32_768, 2_000_000
#: Bytes and terms of the queries that are searched in one pass over the index; more take further passes.
PASS_BYTES, PASS_TERMS = 16 << 20, 100_000
#: Intervals split at once, and documents of an interval that is scored whole.
SPLIT_AT_ONCE, SHORT = 64, 128
#: Constants of the score (fixed values of its definition).
SATURATION, LENGTH_SHARE, SCALE = 8, 90, 1_000_000_000
#: A term: ASCII letters and digits, and every other character beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
_INDEX = "block string, term string, docs array<int>, counts array<int>, ids array<bigint>"


def text_terms(text: str | None) -> list[bytes]:
    """A text's terms, A-Z lower-cased, with repeats."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


class _Block:
    """Documents gathered until they fill a block."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.words: list[np.ndarray] = []
        self.total = 0

    def full(self, more: int) -> bool:
        return bool(self.ids) and (len(self.ids) >= BLOCK_DOCS or self.total + more > BLOCK_WORDS)

    def add(self, doc_id: int | None, own: list[bytes]) -> None:
        number = self.number
        for w in set(own).difference(number):
            number[w] = len(number)
        self.ids.append(doc_id)
        self.sizes.append(len(own))
        self.words.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
        self.total += len(own)

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        """The block's documents (term null: ids, and counts as their lengths), and its posting lists."""
        # A row without id comes last, as in every ranking.
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key = np.concatenate(self.words) * BLOCK_DOCS + np.repeat(place, self.sizes)
        key, counts = np.unique(key, return_counts=True)
        term, doc = key // BLOCK_DOCS, (key % BLOCK_DOCS).astype(np.int32)
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        offsets = np.append(starts, len(key)).astype(np.int32)
        words = list(self.number)
        own = pa.array([None], pa.string())
        yield self._batch(name, own, pa.array([None], pa.list_(pa.int32())), pa.array([[self.sizes[i] for i in order]], pa.list_(pa.int32())), pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())))
        for i in range(0, len(starts), 50_000):
            at = offsets[i : i + 50_001]
            lists = [pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(v[at[0] : at[-1]].astype(np.int32))) for v in (doc, counts)]
            names = pa.array([words[t].decode("utf-8", "surrogatepass") for t in term[at[:-1]]], pa.string())
            yield self._batch(name, names, *lists, pa.nulls(len(names), pa.list_(pa.int64())))

    @staticmethod
    def _batch(name, term, docs, counts, ids):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(term), pa.string()), term, docs, counts, ids], ["block", "term", "docs", "counts", "ids"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    # The partition names the block, so that a task that is run again names its blocks alike.
    task, made, held = TaskContext.get().partitionId(), 0, _Block()
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = text_terms(x.as_py())
            if not own:
                continue
            if held.full(len(own)):
                yield from held.rows(f"{task}-{made}")
                made, held = made + 1, _Block()
            held.add(i, own)
    if held.ids:
        yield from held.rows(f"{task}-{made}")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written to the shared folder: a row for each term of a block (docs, counts), and one of each block's documents (ids, counts; term null).

    Documents without a term aren't in it. Repeated rows are documents each; texts are read whole, however long.
    """
    require_columns(docs, id_col, text_col)
    if not isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError("ids are integers")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return materialize(rows.mapInArrow(_blocks, _INDEX), "lexical-index")


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term) without repeats."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(TERM), F.lit(0))))
    return queries.select(F.col(id_col).alias("item"), found.alias("term")).distinct()


def weight(n_docs: int, df: int) -> int:
    """What a term weighs that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class BlockSearch:
    """One block: its postings of the queries' terms, end to end, and their sparse table."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, sizes: np.ndarray, postings: dict[str, tuple[np.ndarray, np.ndarray]], weights: dict[str, int], n_docs: int, n_terms: int):
        self.ids, self.no_id = ids, no_id
        self.number = {t: i for i, t in enumerate(postings)}
        lists = list(postings.values())
        own = np.repeat(np.arange(len(lists)), [len(d) for d, _ in lists])
        docs = np.concatenate([d for d, _ in lists]).astype(np.int64)
        counts = np.concatenate([c for _, c in lists]).astype(np.int64)
        self.docs, self.keys, self.bounds = docs, own * BLOCK_DOCS + docs, np.cumsum([0, *(len(d) for d, _ in lists)])
        # In Python's integers: ninety times two totals of a large table need more than 64 bits.
        shorter = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * n_docs // n_terms for n in sizes.tolist()], np.int64)
        value = SCALE * counts // (1000 * counts + SATURATION * shorter[docs])
        self.impact = np.array([weights[t] for t in postings], np.int64)[own] * value
        # Level j: the place of the greatest impact among 2^j postings from here on, of equal ones the first.
        self.levels = [np.arange(len(docs), dtype=np.int32)]
        longest = max(len(d) for d, _ in lists)
        for j in range(1, longest.bit_length()):
            last, half = self.levels[-1], 1 << (j - 1)
            level = last.copy()
            a, b = last[:-half], last[half:]
            level[:-half] = np.where(self.impact[a] >= self.impact[b], a, b)
            self.levels.append(level)
        self.table = np.stack(self.levels)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest impact of each range of postings and its place; 0 where a range is empty."""
        n = hi - lo
        j = np.frexp(np.maximum(n, 1))[1] - 1
        lo = np.minimum(lo, len(self.impact) - 1)
        a, b = self.table[j, lo], self.table[j, np.maximum(lo, hi - (1 << j))]
        best = np.where(self.impact[a] >= self.impact[b], a, b)
        return np.where(n > 0, self.impact[best], 0), best

    def scores(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of whole ranges of postings and their exact scores."""
        n = (hi - lo).ravel()
        at = np.repeat(lo.ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
        order = np.argsort(self.docs[at], kind="stable")
        docs = self.docs[at][order]
        if not len(docs):
            return docs, docs
        starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        return docs[starts], np.add.reduceat(self.impact[at][order], starts)

    def search(self, terms: list[str], best: list[tuple[int, bool, int]], top: int) -> list[tuple[int, bool, int]]:
        """``best``, at most ``top`` of (-score, no id, id) in order, with this block's documents taken in."""
        t = np.array([self.number[x] for x in terms if x in self.number], np.int64)
        if not len(t):
            return best
        base = t * BLOCK_DOCS
        begin, end = np.zeros(1, np.int64), np.full(1, len(self.ids), np.int64)
        lo, hi = self.bounds[t][None], self.bounds[t + 1][None]
        bound = self.maxima(lo, hi)[0].sum(1)

        def take(docs: np.ndarray, scores: np.ndarray) -> None:
            nonlocal best
            if len(best) == top:
                good = scores >= -best[-1][0]
                docs, scores = docs[good], scores[good]
            good = scores > 0
            docs, scores = docs[good], scores[good]
            if len(docs) > top:
                # Documents of a block are in order of their ids, so a stable order breaks ties as it should.
                first = np.lexsort((docs, -scores))[:top]
                docs, scores = docs[first], scores[first]
            if len(docs):
                best = sorted([*best, *zip((-scores).tolist(), self.no_id[docs].tolist(), self.ids[docs].tolist(), strict=True)])[:top]

        while True:
            alive = (bound > 0) & (end > begin)
            if len(best) == top:
                worst = -best[-1][0]
                # At an equal score only a smaller id can still get in.
                after = (self.no_id[np.minimum(begin, len(self.ids) - 1)] > best[-1][1]) | ((self.no_id[np.minimum(begin, len(self.ids) - 1)] == best[-1][1]) & (self.ids[np.minimum(begin, len(self.ids) - 1)] >= best[-1][2]))
                alive &= (bound > worst) | ((bound == worst) & ~after)
            if not alive.any():
                return best
            if not alive.all():
                begin, end, lo, hi, bound = begin[alive], end[alive], lo[alive], hi[alive], bound[alive]
            chosen = np.arange(len(bound)) if len(bound) <= SPLIT_AT_ONCE else np.argpartition(-bound, SPLIT_AT_ONCE)[:SPLIT_AT_ONCE]
            rest = np.ones(len(bound), bool)
            rest[chosen] = False
            short = end[chosen] - begin[chosen] <= SHORT
            if short.any():
                take(*self.scores(lo[chosen[short]], hi[chosen[short]]))
            split = chosen[~short]
            b, e, l, h = begin[split], end[split], lo[split], hi[split]
            value, place = self.maxima(l, h)
            row = np.arange(len(split))
            d = self.docs[place[row, value.argmax(1)]] if len(split) else b
            mid = np.searchsorted(self.keys, base[None] + d[:, None])
            held = (mid < h) & (self.keys[np.minimum(mid, len(self.keys) - 1)] == base[None] + d[:, None])
            take(d, np.where(held, self.impact[np.minimum(mid, len(self.keys) - 1)], 0).sum(1))
            new_lo, new_hi = np.concatenate([l, mid + held]), np.concatenate([mid, h])
            begin, end = np.concatenate([begin[rest], b, d + 1]), np.concatenate([end[rest], d, e])
            lo, hi = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi])
            bound = np.concatenate([bound[rest], self.maxima(new_lo, new_hi)[0].sum(1)])


def _searcher(known, top: int):
    """A function for mapInArrow: rows of the index, block by block, to each query's best documents of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, n_terms = known.value
        best: dict[int, list] = {q: [] for q in range(len(queries))}

        def finish(rows: list[tuple]) -> None:
            postings = {t: (d, c) for t, d, c, _ in rows if t is not None}
            if not postings:
                return
            ids, sizes = next((i, c) for t, _, c, i in rows if t is None)
            block = BlockSearch(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null().to_numpy(zero_copy_only=False)), sizes, postings, weights, n_docs, n_terms)
            for q, (_, terms) in enumerate(queries):
                best[q] = block.search(terms, best[q], top)

        name, rows = None, []
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                if block != name:
                    finish(rows)
                    name, rows = block, []
                term = b.column(1)[i].as_py()
                docs, counts = (b.column(k)[i].values for k in (2, 3))
                rows.append((term, docs if term is None else docs.to_numpy(), counts.to_numpy(), b.column(4)[i].values))
        finish(rows)
        found = [(queries[q][0], -s, None if no_id else i) for q, own in best.items() for s, no_id, i in own]
        for at in range(0, len(found), 50_000):
            part = list(zip(*found[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], ["item", "score", "doc"])

    return run


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, doc, score): each query's ``top`` documents of the highest scores above 0, ties to smaller ids.

    ``index`` comes from build_index(). Rows of one item are one query of all their terms; items without
    terms have no result, and rows of null id are an item of their own. Documents without id come last among ties. Queries go
    through the index in passes of bounded size, by the hash of their items. Further columns are ignored; an
    empty index, or no queries, gives no rows.
    """
    require_columns(queries, id_col, text_col)
    spark, kind = index.sparkSession, queries.schema[id_col].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError("ids are integers")
    asked = materialize(query_terms(queries, id_col, text_col).withColumn("item", F.col("item").cast("long")), "query-terms")
    n_terms_asked, n_bytes = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()
    passes = max(1, math.ceil(n_bytes / PASS_BYTES), math.ceil(n_terms_asked / PASS_TERMS))
    sizes = index.where("term is null")
    n_docs, n_terms = sizes.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    part = F.lit(0) if passes == 1 else F.pmod(F.xxhash64("item"), F.lit(passes))
    out = None
    for turn in range(passes):
        mine = asked.where(part == turn)
        terms = mine.select("term").distinct()
        # A pass's terms have a checked size; should one giant query exceed it, Spark joins as it sees fit.
        held = index.where("term is not null").join(F.broadcast(terms) if passes == 1 else terms, "term", "left_semi").select(*[F.col(c) for c in index.columns])
        postings = materialize(held, "query-postings")
        df = dict(tuple(r) for r in postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect())
        own: dict = {}
        for item, term in mine.collect():
            if term in df:
                own.setdefault(item, []).append(term)
        if not own:
            continue
        known = spark.sparkContext.broadcast(([(i, sorted(t)) for i, t in own.items()], {t: weight(n_docs, n) for t, n in df.items()}, n_docs, n_terms))
        rows = postings.unionByName(sizes).repartition("block").sortWithinPartitions("block")
        found = rows.mapInArrow(_searcher(known, top), "item bigint, score bigint, doc bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item bigint, score bigint, doc bigint")
    # A task gives ``top`` rows a query at most, however many blocks it had.
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").cast(kind).alias("item"), "rank", "doc", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").cast("long").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP11_SQL = r"""
with t as (
  select d.doc_id, d.r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as r from documents) d),
p as (select doc_id, r, term, count(*) as tf from t group by all),
n as (select r, sum(tf)::bigint as n from p group by r),
s as (select count(*) as n_docs, sum(n)::bigint as n_terms from n),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
f as (select term, count(*) as df from p semi join q using (term) group by term),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from f, s),
c as (
  select q.item_id, p.doc_id, p.r, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * n.n * s.n_docs) // s.n_terms))))::bigint as score
  from q join p using (term) join w using (term) join n on n.r = p.r, s group by q.item_id, p.doc_id, p.r),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from c where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""
