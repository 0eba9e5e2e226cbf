from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from conftest import SMALL, rows

from tuneline.llm import lexical


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, queries, top=10):
    """Every document scored for every query, by the definition."""
    held = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    asked, out = {}, []
    for item, text in queries:
        asked.setdefault(item, set()).update(plain_terms(text))
    for item, terms in asked.items():
        w = {}
        for t in terms:
            df = sum(t in set(own) for _, own in held)
            if df:
                w[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        found = []
        for i, own in held:
            m = 10 + 90 * len(own) * n_docs // n_terms
            s = sum(x * (1000000000 * own.count(t) // (1000 * own.count(t) + 8 * m)) for t, x in w.items() if t in own)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def run(spark, docs, queries, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame(queries, "item_id long, text string")
    found = lexical.search(lexical.build_index(docs), queries, **more)
    return sorted([(r["item"], r["rank"], r["doc"], r["score"]) for r in found.collect()], key=str)


def test_terms():
    for text in ("Ab-c'D_é9 ÉA\x7f😀z", "", None, "\x00A\x01", "ſK"):
        assert [t.decode() for t in lexical.text_terms(text)] == plain_terms(text)


def _words(rng, n, size):
    return " ".join(f"w{min(int(rng.expovariate(0.08)), n)}" for _ in range(size))


@pytest.mark.parametrize("shape", ["prose", "copies", "ascending"])
def test_block_search_equals_plain(shape):
    """Intervals, bounds and ties on one block, whatever the order of impacts."""
    rng = random.Random(shape)
    n = 900
    if shape == "prose":
        docs = [(3 * i, _words(rng, 60, rng.randint(1, 60))) for i in range(n)]
    elif shape == "copies":
        docs = [(i, "w1 w2 w3 w9 x" if i % 3 else _words(rng, 20, 5)) for i in range(n)]
    else:
        docs = [(i, " ".join(["w1"] * (i // 30 + 1) + ["w2"] * 3 + [f"u{i}"])) for i in range(n)]
    queries = [(q, _words(rng, 60, rng.randint(1, 12)) + " w1 w2") for q in range(25)]
    held = lexical._Block()
    for i, t in docs:
        held.add(i, lexical.text_terms(t))
    table = [r for b in held.rows("0-0") for r in b.to_pylist()]
    post = {r["term"]: (np.array(r["docs"]), np.array(r["counts"])) for r in table if r["term"] is not None}
    own = next(r for r in table if r["term"] is None)
    n_terms = sum(own["counts"])
    block = lexical.BlockSearch(np.array(own["ids"]), np.zeros(n, bool), np.array(own["counts"]), post, {t: lexical.weight(n, len(d)) for t, (d, _) in post.items()}, n, n_terms)
    got = [(q, k + 1, i, -s) for q, t in queries for k, (s, _, i) in enumerate(block.search(sorted(set(plain_terms(t))), [], 10))]
    assert sorted(got, key=str) == plain_search(docs, queries)


def test_search_gives_intervals_up(monkeypatch):
    """A few outstanding documents bound the rest, which is never scored."""
    docs = [(i, "w1 w2 " + ("rare " * 9 if i % 500 == 0 else f"u{i}")) for i in range(6000)]
    held = lexical._Block()
    for i, t in docs:
        held.add(i, lexical.text_terms(t))
    table = [r for b in held.rows("0-0") for r in b.to_pylist()]
    post = {r["term"]: (np.array(r["docs"]), np.array(r["counts"])) for r in table if r["term"] in ("w1", "rare")}
    own = next(r for r in table if r["term"] is None)
    block = lexical.BlockSearch(np.array(own["ids"]), np.zeros(6000, bool), np.array(own["counts"]), post, {t: lexical.weight(6000, len(d)) for t, (d, _) in post.items()}, 6000, sum(own["counts"]))
    scored, plain = [], lexical.BlockSearch.scores
    monkeypatch.setattr(lexical.BlockSearch, "scores", lambda self, lo, hi: scored.append(int((hi - lo).max(1).sum())) or plain(self, lo, hi))
    best = block.search(["rare", "w1"], [], 10)
    assert [i for _, _, i in best] == [500 * i for i in range(10)]
    assert sum(scored) < 3000


def test_search_equals_plain_over_many_blocks_and_passes(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(None if i % 97 == 0 else i // 2, _words(rng, 80, rng.randint(0, 50))) for i in range(600)]
    docs += [(7, None), (8, ""), (None, "w1 w1"), (None, "w1 w1")]
    queries = [(q, _words(rng, 80, rng.randint(0, 14))) for q in range(20)] + [(3, "w1 zzz"), (50, None), (51, "--"), (52, "absent"), (None, "w2 w5")]
    want = plain_search(docs, queries)
    assert run(spark, docs, queries) == want
    monkeypatch.setattr(lexical, "PASS_TERMS", 40)
    assert run(spark, docs, queries) == want
    assert run(spark, docs, queries, top=3) == plain_search(docs, queries, 3)


def test_long_and_empty(spark):
    docs = [(1, "a " * 2_100_000 + "b"), (2, "a b"), (3, "b " * 5)]
    assert run(spark, docs, [(0, "A b")]) == plain_search(docs, [(0, "a b")])
    assert run(spark, [], [(0, "a")]) == [] and run(spark, docs[1:], []) == []
    clash = spark.createDataFrame([(1, "a b", "t", 5)], "doc_id long, text string, term string, block int")
    assert lexical.search(lexical.build_index(clash), spark.createDataFrame([(4, "b", 1)], "item_id long, text string, score int")).first()["doc"] == 1


def test_query_equals_its_sql(spark, duck):
    found = rows(lexical.op11_lexical_search(spark, SMALL))
    assert found == rows(duck.sql(lexical.OP11_SQL)) and len(found) > 300
