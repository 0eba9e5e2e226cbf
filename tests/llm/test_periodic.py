from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from tuneline.llm import periodic


def plain_runs(w):
    """Every maximal stretch of each lag, kept if no smaller lag is a period of it."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_words(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 1), max_size=90), st.lists(st.integers(0, 3), max_size=90)))
def test_runs_equal_the_plain_scan(w):
    assert periodic.word_runs(w) == plain_runs(w)


def test_planted_runs_equal_the_plain_scan():
    rng = random.Random(5)
    for _ in range(400):
        w = []
        while len(w) < 120:
            block = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(1, 9))]
            w += (block * rng.randint(1, 8))[: rng.randint(1, 40)]
        runs = periodic.word_runs(w)
        assert runs == plain_runs(w)
        assert [w[i] for i in np.flatnonzero(periodic.kept_words(len(w), runs))] == plain_kept(w, runs)


def test_segments_are_stable_and_lose_no_run():
    rng = random.Random(7)
    for _ in range(300):
        w = np.array([min(int(rng.expovariate(0.3)), 30) for _ in range(rng.randint(6, 400))], np.int32)
        parts = periodic.segments(w)
        for a, b in parts:
            assert b - a >= periodic.LEAST and np.unique(w[a:b], return_counts=True)[1].min() >= periodic.TIMES
        for s, n, _ in plain_runs(w.tolist()):
            assert any(a <= s and s + n <= b for a, b in parts)


@pytest.mark.parametrize("words", [
    ["a"] * 300_000, ["a", "b"] * 150_000, [*"aaaaaab"] * 40_000,
    [str(x) for x in np.random.default_rng(3).integers(0, 2, 300_000)],
    [str(x) for x in np.random.default_rng(3).integers(0, 60_000, 300_000)],
    # Each level of splitting takes three words off the end.
    [str(i) for i in range(50_000) for _ in range(3)] + [str(i) for i in range(50_000)],
], ids=["one", "two", "runs-within", "coin", "rare", "onion"])
def test_long_texts_take_bounded_time(words):
    began = time.perf_counter()
    runs = periodic.word_runs(words)
    assert time.perf_counter() - began < 60
    assert all(n >= max(6, 4 * q) for _, n, q in runs)


def test_query_equals_plain(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in periodic.op13_periodic_runs(spark, SMALL).collect()}
    assert found.keys() == docs.keys()
    seen = 0
    for i, text in docs.items():
        words = plain_words(i, text)
        if len(words) > 1500:
            runs = periodic.word_runs(words)
            assert all(words[k] == words[k + q] for s, n, q in runs for k in range(s, s + n - q))
        else:
            runs = plain_runs(words)
        seen += len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert found[i]["n_runs"] == len(runs)
        assert (found[i]["start"], found[i]["length"], found[i]["period"], found[i]["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert found[i]["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert found[i]["collapsed_sha256"] == hashlib.sha256(b" ".join(plain_kept(words, runs))).hexdigest()
    assert seen > 5


def test_edge_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, " \t\n", "z"), (None, "a a a a a a", "w"), (4, "é b " * 5 + "c", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect())
    # A no-break space isn't a blank.
    assert got == [("1", [], ""), ("1", [], ""), ("2", [], ""), ("3", [], ""), ("4", [], "é b é b é b é b é b c"), ("None", [(0, 6, 1)], "a")]
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
    assert {r["text"] for r in periodic.with_loops(docs).collect() if r["doc_id"] in (1, 2)} <= {None, ""}
