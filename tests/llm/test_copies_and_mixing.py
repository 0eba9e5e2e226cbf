"""Line dedup, near-duplicates and mixing against brute force and SQL."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from conftest import SMALL, rows
from plain import brute_groups, brute_lines
from pyspark.sql import functions as F

from tuneline.llm import line_dedup, mixing, near_dup, queries


def _documents(texts, spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, _hash string")


@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_runs_equal_brute_force(spark, window):
    rng = random.Random(window)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 5))) for _ in range(14)]
    texts = [None, "", "\n", "a b c d e f g\na b c d e f g\na b c d e f g"] + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    least = {1: 3, 2: 6, 3: 16}[window]
    # A window of w lines guarantees runs of w lines; longer lines stand alone.
    if window == 3:
        texts = [t if t is None else "\n".join(x or "a" for x in t.split("\n")) for t in texts]
        least = 11
    got = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(_documents(texts, spark), min_words=least, window=min(window, 2)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, least)


def test_line_dedup_sql_and_edges(spark, duck):
    assert rows(queries.QUERIES["op1_line_dedup"](spark, SMALL)) == rows(duck.sql(queries.ORACLE_SQL["op1_line_dedup"]))
    long = "word " * 60
    docs = spark.createDataFrame([(1, long), (1, long), (2, f"x\n{long}"), (None, long), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.without_repeats(docs).collect())
    # The row without id comes first in order, so its copy is the one that stays; equal rows share a result.
    assert got == [("2", "x"), ("3", None), ("4", ""), ("None", long)]
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0
    assert line_dedup.cleaned(_documents(["a"], spark)).columns == ["doc_id", "text", "_hash", "_lines", "_removed"]
    own = _documents([long, f"{long}\nx"], spark).selectExpr("doc_id", "text", "7 as _lines", "8 as _removed", "9 as runs")
    got = sorted((r["doc_id"], r["text"], r["_lines"], r["_removed"], r["__lines"], r["__removed"]) for r in line_dedup.cleaned(own).collect())
    assert got == [(0, long, 7, 8, 1, 0), (1, "x", 7, 8, 2, 1)]
    huge = "\n".join(f"line {i} of a text" for i in range(40_000))
    texts = [huge, f"before\n{huge}"]
    assert [r["text"] for r in line_dedup.cleaned(_documents(texts, spark)).orderBy("doc_id").collect()] == [huge, "before"]


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_groups({r["doc_id"]: r["text"] for r in docs.collect()}, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op8_near_dup"](spark, SMALL).collect()}
    assert got == want


@pytest.mark.parametrize(("broadcast", "few"), [(0, 0), (50_000, 8)])
def test_dense_families_and_chains(spark, monkeypatch, broadcast, few):
    for name, value in {"BLOCK": 60, "SEATS": 50, "WHOLE": 20, "SPLIT": 60, "BROADCAST": broadcast, "FEW": few}.items():
        monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = {}
    for i in range(220):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8])):
            own[rng.randrange(150)] = rng.choice(words)
        texts[i] = " ".join(own)
    chain = list(base[::-1])
    for i in range(30):
        chain[i * 4] = rng.choice(words)
        texts[1000 + i] = " ".join(chain)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, words=3, percent=85).collect()}
    assert got == brute_groups(texts, 3, 85)


def test_boilerplate_below_the_threshold_meets_nobody(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(near_dup, "rare_places", lambda *a, f=near_dup.rare_places: seen.append(f(*a)) or seen[-1])
    rng, n = random.Random(8), 50_000
    frame = " ".join(f"frame{i}" for i in range(60))
    texts = [(i, f"{frame} " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(6))) for i in range(n)]
    # Any two share 58 of 70 shingles; every thousandth has a copy with a word more.
    texts += [(n + i, f"{texts[i][1]} more") for i in range(0, n, 1000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, words=3, percent=85).collect()}
    assert got == {i: i - n if i >= n else i for i, _ in texts}
    # All rows lie in large regions, and none shares a rare shingle with another component.
    assert len(seen) == 1 and seen[0].count() == 0


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame([(5, "A b c d"), (3, "a B c d"), (3, "a b c d"), (9, None), (8, ""), (7, "one"), (6, "ONE"), (None, "one"), (4, "É"), (2, "é")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {(5, 1, 3, False), (3, 1, 3, True), (9, 0, 9, True), (8, 0, 8, True), (7, 1, 6, False), (6, 1, 6, True), (None, 1, None, True), (4, 1, 4, True), (2, 1, 2, True)}
    assert near_dup.one_of_each(docs).count() == 8
    odd = docs.selectExpr("doc_id", "text", "1 as component", "2 as id", "3 as region", "4 as _text", "5 as _id", "6 as kept", "7 as n_shingles")
    assert near_dup.near_duplicates(odd).count() == 10 and near_dup.one_of_each(odd).columns == odd.columns
    rng = random.Random(1)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    pair = spark.createDataFrame([(1, " ".join(long)), (2, " ".join([*long[:-9], "other"])), (3, " ".join(long[::-1]))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(pair).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_mix_sql(spark, duck):
    assert rows(queries.QUERIES["op9_mixing"](spark, SMALL)) == rows(duck.sql(queries.ORACLE_SQL["op9_mixing"]))


def test_targets_and_flow():
    goal = mixing.targets({"a": 100, "b": 100, None: 100, "c": 1})
    # c is full at twice its size; a and the null source weigh 5, b weighs 2.
    assert goal["c"] == 2 and goal["a"] == goal[None] == pytest.approx(449.5 * 5 / 12) and goal["b"] == pytest.approx(449.5 * 2 / 12)
    assert sum(goal.values()) == pytest.approx(1.5 * 301) and mixing.targets({}) == {}
    # Overlap: the shared pattern fills the source that nothing else can, without repeats.
    flow = mixing.route([100, 100], [(0,), (0, 1)], [100, 100])
    assert flow == [{0: 100}, {1: 100}]
    flow = mixing.route([100, 100], [(0,), (0, 1)], [250, 100])
    assert sum(f.get(0, 0) for f in flow) == 250 and flow[1][1] == 100


def _cheapest(supply, members, quota):
    """The most words that quotas take, and the fewest repeats for them, by trying every way (small numbers)."""
    best, ways = (0, 0), [(quota, 0, 0)]
    for n, own in zip(supply, members, strict=True):
        new = set()
        for left, taken, cost in ways:
            for split in itertools.product(range(2 * n + 1), repeat=len(own)):
                if sum(split) <= 2 * n and all(x <= left[j] for x, j in zip(split, own, strict=True)):
                    rest = list(left)
                    for x, j in zip(split, own, strict=True):
                        rest[j] -= x
                    new.add((tuple(rest), taken + sum(split), cost + max(0, sum(split) - n)))
        ways = new
    best = max((taken, -cost) for _, taken, cost in ways)
    return best


def test_flow_equals_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        supply = [rng.randint(1, 3) for _ in range(3)]
        members = [tuple(sorted(rng.sample(range(3), rng.randint(1, 2)))) for _ in range(3)]
        quota = tuple(rng.randint(0, 5) for _ in range(3))
        taken = mixing.flows(supply, members, list(quota))
        assert (sum(taken), -sum(max(0, t - n) for t, n in zip(taken, supply, strict=True))) == _cheapest(supply, members, quota)
        routed = mixing.route(supply, members, list(quota))
        assert all(sum(f.get(j, 0) for f in routed) <= q for j, q in enumerate(quota)) and sum(sum(f.values()) for f in routed) == sum(taken)


def test_flow_of_many_patterns():
    rng, began = random.Random(5), time.perf_counter()
    members = list({tuple(sorted(rng.sample(range(60), rng.randint(1, 5)))) for _ in range(21_000)})[:19_000]
    supply = [rng.randint(1, 10**6) for _ in members]
    quota = [int(sum(supply) * 1.5 / 60 * rng.uniform(0.2, 1.8)) for _ in range(60)]
    taken = mixing.flows(supply, members, quota)
    assert 0.9 * sum(quota) <= sum(taken) <= sum(quota) and time.perf_counter() - began < 60
    # Beyond the bound sources without shared documents need no flow, however many.
    assert mixing.flows([3] * 200_000, [(j,) for j in range(200_000)], [4] * 200_000) == [4] * 200_000


def test_the_closed_form_equals_the_flow(monkeypatch):
    """Alone or beside sources that share documents, a source of its own gets the same from both."""
    rng = random.Random(9)
    for _ in range(60):
        own = rng.randint(1, 8)
        members = [(j,) for j in range(own)] + [tuple(sorted(rng.sample(range(own, own + 3), rng.randint(1, 2)))) for _ in range(rng.randint(0, 3))]
        supply, quota = [rng.randint(0, 9) for _ in members], [rng.randint(0, 20) for _ in range(own + 3)]
        monkeypatch.setattr(mixing, "MAX_SHARED", 20_000)
        routed = mixing.flows(supply, members, quota)
        monkeypatch.setattr(mixing, "MAX_SHARED", len(members) - own if len(members) > own else 0)
        assert mixing.flows(supply, members, quota)[:own] == routed[:own] and sum(mixing.flows(supply, members, quota)) == sum(routed)


def test_registered_mix_runs_the_flow(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(mixing, "route", lambda supply, *a, f=mixing.route: asked.append(len(supply)) or f(supply, *a))
    mixing.op9_mixing(spark, SMALL)
    sources = spark.read.parquet(f"{SMALL}/documents.parquet").select("source").distinct().count()
    assert asked == [sources]


def test_mix_edges(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 9)), "ab"[i % 2] if i % 7 else None, 1) for i in range(400)] + [(400, None, "a", 1), (401, "", "z", 1)], "doc_id long, text string, source string, copies int")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.exceptAll(mixing.mix_documents(docs.repartition(3))).count() == 0
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    shared = docs.withColumn("source", F.array(F.lit("x"), F.when(F.col("doc_id") % 2 == 0, "y")))
    assert mixing.mix_documents(shared).count() > 0


def test_confirming_is_dealt_out_by_shingles(spark, monkeypatch):
    """Links of long texts are spread over parts by their shingles, and none is lost."""
    texts = {i: " ".join(f"w{i // 10}-{j}" for j in range(400)) + f" end{i % 3}" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_groups(texts, 3, 85)
    held = []
    monkeypatch.setattr(near_dup, "_confirm", lambda *a, f=near_dup._confirm: held.append(1) or f(*a))
    for most in (near_dup.BLOCK_SHINGLES, 500):
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", most)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, words=3, percent=85).collect()}
        assert got == want and held
