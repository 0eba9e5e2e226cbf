"""Periodic runs of words, found by recursive frequency splitting and a lag scan, and collapsed to one period.

A run repeats its period four times at least, so each of its words occurs four times in it. A word
that occurs less often within a segment is in none of the segment's runs and splits it; the parts
are split again until nothing changes. What survives is scanned lag by lag. A run of period q has
3q neighbouring places that equal those q further on, hence three multiples of q among them:
only multiples are looked at, which makes all lags together cost a segment's length times its logarithm.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.llm.common import WORD, table
from tuneline.session import require_columns

#: A run repeats its period so many times, and has so many words, at least.
TIMES, LEAST = 4, 6
#: Words of a segment up to which it is counted anew in place of keeping its parent's counts.
_SHORT = 64

Run = tuple[int, int, int]


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """The parts (start, end) of a text of word numbers in which every word occurs TIMES times or more and that are LEAST words or longer.

    Only the smaller parts of a split are counted; the largest keeps what is left of its parent's
    counts, so a word is counted no more often than its part's length can halve.
    """
    n = len(ids)
    if n < LEAST:
        return []
    often = np.bincount(ids)[ids] >= TIMES
    edges = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
    begun = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= LEAST]
    if not begun:
        return []
    where: dict[int, list[int]] = {}
    words = ids.tolist()
    for a, b in begun:
        for i in range(a, b):
            where.setdefault(words[i], []).append(i)
    out: list[tuple[int, int]] = []
    # A segment, its counts, and the words whose counts may have become too small.
    work = [(a, b, counts := Counter(words[a:b]), list(counts)) for a, b in begun]
    while work:
        a, b, counts, changed = work.pop()
        cuts = sorted(i for w in changed if 0 < counts[w] < TIMES for i in where[w][bisect_left(where[w], a) : bisect_left(where[w], b)])
        if not cuts:
            out.append((a, b))
            continue
        parts = [(s, e) for s, e in zip([a, *(c + 1 for c in cuts)], [*cuts, b], strict=True) if e > s]
        if not parts:
            continue
        largest = max(parts, key=lambda p: p[1] - p[0])
        for s, e in parts:
            if (s, e) != largest and e - s >= LEAST:
                work.append((s, e, own := Counter(words[s:e]), list(own)))
        s, e = largest
        if e - s < LEAST:
            continue
        if e - s <= _SHORT:
            work.append((s, e, own := Counter(words[s:e]), list(own)))
            continue
        gone = Counter(words[a:s])
        gone.update(words[e:b])
        for w, k in gone.items():
            counts[w] -= k
        work.append((s, e, counts, list(gone)))
    return sorted(out)


def _extent(w: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest stretch of places around ``at`` that equal those q further on, looked at in growing steps."""
    n, lo, hi, step = len(w) - q, at, at, 32
    while hi < n:
        end = min(n, hi + step)
        same = w[hi:end] == w[hi + q : end + q]
        if not same.all():
            hi += int(np.argmin(same))
            break
        hi, step = end, step * 2
    step = 32
    while lo > 0:
        begin = max(0, lo - step)
        same = w[begin:lo] == w[begin + q : lo + q]
        if not same.all():
            lo -= int(np.argmin(same[::-1]))
            break
        lo, step = begin, step * 2
    return lo, hi


def lag_scan(w: np.ndarray) -> list[Run]:
    """Runs (start, length, period) of a segment, each with its smallest period, as long as they go within it."""
    n, found = len(w), []
    known: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of the runs of each period
    # Places that are tried first: most candidates differ in one of them.
    probes = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
    for q in range(1, n // TIMES + 1):
        at_q = w[::q]
        same = at_q[1:] == at_q[:-1]
        if len(same) < TIMES - 1:
            continue
        idx = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * q
        for o in (q // 2, *(p for p in probes if p < q)):
            if not len(idx):
                break
            idx = idx[w[idx + o] == w[idx + o + q]]
        if not len(idx):
            continue
        divisors = [d for d in known if d < q and q % d == 0]
        at = 0
        while at < len(idx):
            x, beyond = int(idx[at]), None
            for d in divisors:
                # Where a window of q words lies in a run whose period divides q, so does the whole stretch.
                starts, ends = known[d]
                k = bisect_right(starts, x) - 1
                if k >= 0 and x + q <= ends[k]:
                    beyond = ends[k] - q + 1
                    break
            if beyond is None:
                if not np.array_equal(w[x : x + 2 * q], w[x + q : x + 3 * q]):
                    at += 1
                    continue
                lo, hi = _extent(w, x, q)
                beyond = hi + 1
                if hi - lo + q >= max(LEAST, TIMES * q):
                    found.append((lo, hi - lo + q, q))
                    starts, ends = known.setdefault(q, ([], []))
                    starts.append(lo)
                    ends.append(hi + q)
            at = int(np.searchsorted(idx, max(beyond, x + 1)))
    return found


def word_runs(words: list) -> list[Run]:
    """(start, length, period) of every run of a list of words, by start, then period.

    A run is a stretch with a smallest period q and max(LEAST, TIMES * q) words or more, as long as it goes.
    """
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    out = [(a + s, n, q) for a, b in segments(ids) for s, n, q in lag_scan(ids[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        sizes, runs, texts = [], [], []
        for x in b.column(1):
            # Splitting bytes parts words at the six ASCII blanks and nowhere else.
            words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
            found = word_runs(words)
            if found:
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), found))]
            sizes.append(len(words))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, kind), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["_id", "runs", "collapsed", "n_kept"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, ``runs`` (array of start, length, period in words, by start, then period), ``collapsed`` and ``n_kept``.

    ``collapsed`` is the text's words with one blank between them, of every run only its first period, n_kept their
    number. Null and blank texts have no run and collapse to an empty text; repeated rows are read each; texts are
    read whole, however long. Further columns are ignored, whatever their names; an empty table gives an empty table.
    """
    require_columns(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_find, f"_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string, n_kept bigint").withColumnRenamed("_id", id_col)


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which about a tenth of the texts end in a loop, chosen and shaped by crc32 of their ids, as op13's contract states it."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    loop = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(loop, F.lit(1), n - a)), " ")
    return docs.withColumn(text_col, F.when((h % 10 == 0) & (n > 0), looped).otherwise(F.col(text_col)))


def _spelled(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_loops(table(spark, sf_dir, "documents")))
    # The longest run; of equal ones that of the smallest start, then period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(_spelled(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_kept",
    )
