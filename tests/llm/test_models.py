"""Classifier, toxicity, neighbours and the pipeline: held-out accuracy, brute force, edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from plain import brute_groups, brute_lines

import corpus_pipeline
from tuneline.llm import common, hnsw, line_dedup, nearest, quality_classifier, queries, toxicity

EDGES = [(1, "", "x"), (2, None, "x"), (3, "word " * 30_000, "x"), (3, "word " * 30_000, "x"), (4, "!!! ???", "x")]


def _edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, _text string")


def test_quality_classifier(spark):
    got = queries.QUERIES["op4_quality_classifier"](spark, SMALL)
    found = got.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(found) > 5 and np.mean([r["predicted"] == r["quality"] for r in found]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in found)


def test_quality_edges(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out = quality_classifier.score(_edges(spark), labels, ~common.held_out("doc_id", 3, 1)).collect()
    assert len(out) == 5 and len({r["score"] for r in out if r["doc_id"] == 3}) == 1
    assert {r["score"] for r in quality_classifier.score(_edges(spark), labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality_classifier.score(_edges(spark).limit(0), labels, F.lit(True)).count() == 0
    assert quality_classifier.keep_good(_edges(spark), labels.limit(0)).columns == ["doc_id", "text", "_text"]


def test_repeated_ids_count_once_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(7, f"copy {i % 2}") for i in range(500)] + [(8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(7, 1)] * 300 + [(7, 0), (None, 1)], "doc_id long, quality int")
    got = [tuple(r) for r in common.labelled_sample(docs, labels, "doc_id", "text", "quality", {0: 4, 1: 10}, F.lit(True)).collect()]
    keys = [(k, label) for _, label, k in got]
    assert len(keys) == len(set(keys)) and sum(label for _, label in keys) == 10 and len(keys) == 14
    again = [tuple(r) for r in common.labelled_sample(docs.repartition(7), labels, "doc_id", "text", "quality", {0: 4, 1: 10}, F.lit(True)).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)


def test_votes_weigh_by_similarity():
    voters = np.array([[1.0, 0.0], [0.0, 1.0]])
    got = quality_classifier.vote(np.array([[1.0, 0.0], [0.0, 1.0], [0.8, 0.6]]), voters, np.array([1.0, 0.0]), k=2)
    assert got[0] > 0.99 and got[1] < 0.01 and 0.5 < got[2] < 1


def _bag(text, number):
    ids, sentence = toxicity.number_words(text, number)
    terms = np.array([toxicity.word_terms(w) for w in number], np.int32)
    return terms[ids].ravel(), sentence


def test_sentences_learn_from_documents():
    rng = np.random.default_rng(1)
    words = [f"clean{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(300):
        sentences = [" ".join(rng.choice(words, 6)) for _ in range(4)]
        if i % 3 == 0:
            sentences[int(rng.integers(4))] += " vileword"
        texts.append(". ".join(sentences)), labels.append(int(i % 3 == 0))
    number = toxicity._numbered()
    weight, bias = toxicity.fit([_bag(t, number) for t in texts], np.array(labels), 1 / 3)
    model = toxicity.SentenceModel(weight, bias)
    number = toxicity._numbered()
    ids, sentence = toxicity.number_words("clean1 clean2. you vileword here. clean3", number)
    own, p = model.sentences(ids, sentence, model.word_weights(list(number)))
    assert own.tolist() == [0, 1, 2] and p[1] > 0.5 and p[0] < 0.2 and p[2] < 0.2


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = queries.QUERIES["op7_toxicity"](spark, SMALL).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        assert r["worst_start"] is None or text[r["doc_id"]][r["worst_start"] : r["worst_start"] + r["worst_length"]].strip() != ""
    out = {r["doc_id"]: r for r in toxicity.score(_edges(spark), labels, F.lit(False)).collect()}
    assert out[1]["score"] == out[2]["score"] == 0 and out[3]["score"] < 0.1 and out[4]["worst_sentence"] is None
    assert toxicity.score(_edges(spark).limit(0), labels, F.lit(True)).count() == 0


def _recall(x, queries, k=20):
    """Recall of each query's k nearest, on a graph of all of ``x`` searched as a shard is."""
    graph = hnsw.build(hnsw.linked(x))
    found, _ = hnsw.search(x.astype(np.float32), graph, hnsw.directions(x[queries]), k + 1, hnsw.beam_for(x, graph, k + 1))
    products = x[queries] @ x.T
    products[np.arange(len(queries)), queries] = -np.inf
    want = np.argsort(-products, axis=1)[:, :k]
    return np.array([len({i for i in f.tolist() if i != q} & set(w.tolist())) / k for q, f, w in zip(queries, found, want, strict=True)])


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("shape", ["isotropic", "unequal norms", "clusters", "tight groups", "one direction, unequal norms", "half a direction, unequal norms", "one direction", "wide"])
def test_recall_of_a_full_shard(shape):
    rng, n = np.random.default_rng(1), nearest.SHARD_NODES
    x = _unit(rng.normal(size=(n, 128 if shape == "wide" else 64)))
    if "direction" in shape:
        share = 0.5 if "half" in shape else 0.9
        x = _unit(np.sqrt(share) * _unit(rng.normal(size=(1, 64))) + np.sqrt(1 - share) * x)
    if "unequal norms" in shape:
        x *= rng.uniform(1 / nearest.BAND, 1, (n, 1))
    if shape == "clusters":
        x = x[rng.integers(0, 100, n)] + rng.normal(size=(n, 64)) * 0.1
    if shape == "tight groups":
        x = _unit(x[rng.integers(0, 500, n)] + rng.normal(size=(n, 64)) * 0.005)
    recall = _recall(x, rng.choice(n, 200, replace=False))
    assert recall.mean() >= 0.95 and recall.min() > 0.5


def test_graph_of_one_node():
    x = np.ones((1, 3))
    assert hnsw.search(x.astype(np.float32), hnsw.build(hnsw.directions(x)), np.ones((1, 3), np.float32), 3)[0].tolist() == [[0, -1, -1]]


def test_shards_keep_to_lengths_and_bands():
    got = nearest.deal([(64, 0, 60_000), (64, 1, 10), (64, 2, 20), (64, 9, 20), (64, -3, 5), (8, 0, 7)])
    assert nearest.deal([(4096, 0, 5_000)]) == [(4096, 0, 0, 5)]
    assert got == [(8, 0, 0, 1), (64, -3, 1, 1), (64, 0, 2, 3), (64, 1, 5, 1), (64, 2, 5, 1), (64, 9, 6, 1)] and nearest.deal([]) == []


def test_unequal_norms_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_NODES", 400)
    monkeypatch.setattr(nearest, "LEAST_BLOCK", 20)
    rng = np.random.default_rng(7)
    x = _unit(rng.normal(size=(3000, 16))) * np.exp(rng.normal(size=(3000, 1)))
    x[7] *= 1e200
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, shard int")
    got: dict = {}
    for r in nearest.nearest(df, F.col("id") % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: {int(i) for i in np.argsort(-np.where(np.arange(3000) == q, -np.inf, x @ x[q]))[:10]} for q in range(0, 3000, 20)}
    assert sorted(got) == sorted(want) and np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.98


def test_nearest_equals_brute_force(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect() if r["embedding"] is not None}
    got: dict = {}
    for r in queries.QUERIES["op6_nearest"](spark, SMALL).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == sorted(i for i in rows if i % 20 == 0)
    recall = []
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21)) and all(s == pytest.approx(float(rows[q] @ rows[v])) for v, s in found.values())
        want = sorted((-float(rows[q] @ x), i) for i, x in rows.items() if i != q)[:20]
        recall.append(len({i for _, i in want} & {v for v, _ in found.values()}) / 20)
    assert np.mean(recall) >= 0.9


def test_nearest_edges(spark):
    same = [1.0, 0.0]
    data = [(i, same) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [1.0, None]), (104, [1.0]), (120, [0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest.nearest(df, F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 40: [0, 1, 2, 3, 4], 120: [0, 1, 2, 3, 4]}
    short = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [1.0, 1.0]), (2, [0.5, 0.0]), (40, [1.0, 0.0, 0.0])], df.schema)
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in nearest.nearest(short, F.col("id") % 20 == 0).collect()) == [(0, 1, 2.0), (20, 2, 0.5)]
    few = nearest.nearest(df.where("vec_id in (0, 120)"), F.col("id") % 20 == 0, k=5)
    assert sorted((r["query_id"], r["vec_id"]) for r in few.collect()) == [(0, 120), (120, 0)]
    assert nearest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_toxicity_of_held_out_documents(spark):
    large = "/root/testdata/sf0.1"
    got = queries.QUERIES["op7_toxicity"](spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in got if r["toxic"] == y] for y in (1, 0))
    assert len(toxic) > 100 and np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.01


def test_fit_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, *a, f=toxicity.fit: sizes.append(sum(t.nbytes for t, _ in bags)) or f(bags, *a))
    for most in (1, 100_000, 1 << 30):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", most)
        assert toxicity.score(docs, labels, F.lit(True)).count() == docs.count()
    assert sizes[0] == 0 < sizes[1] <= 100_000 < sizes[2]


def _tokens(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


def test_pipeline_stages_equal_brute_force(spark, duck):
    """Each stage on what the one before it kept, against a plain version of it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert list(stages) == ["quality", "lines", "near_duplicates", "mix", "encode"]
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    kept = stages["quality"](spark, docs, SMALL)
    scores = quality_classifier.score(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), F.lit(True)).collect()
    assert text(kept) == {i: t for i, t in text(docs).items() if i in {r["doc_id"] for r in scores if r["score"] >= 0.5}}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()} & set(text(docs))
    assert len(good & set(text(kept))) >= 0.95 * len(good) and len(text(kept)) < docs.count()
    # Ids rise in the order in which the plain version goes through texts.
    before = text(kept)
    order = sorted(before)
    after = dict(zip(order, brute_lines([before[i] for i in order], line_dedup.MIN_WORDS), strict=True))
    alive = {i: t for i, t in after.items() if t == before[i] or (t or "").strip(" \t\n\r\x0b\x0c")}
    kept = stages["lines"](spark, kept, SMALL)
    assert text(kept) == alive and all(r["n_chars"] == len(r["text"]) for r in kept.collect())
    kept = stages["near_duplicates"](spark, kept, SMALL)
    assert text(kept) == {i: alive[i] for i, (_, least) in brute_groups(alive, 5, 80).items() if least == i}
    con = duck.cursor()
    con.register("documents", kept.toPandas())
    want = dict(con.sql(f"select doc_id, copies from ({queries.ORACLE_SQL['op9_mixing']}) where copies > 0").fetchall())
    mixed = stages["mix"](spark, kept, SMALL)
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want and mixed.columns == columns
    ids = {i: _tokens(alive[i]) for i in want}
    got = stages["encode"](spark, mixed, SMALL).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = sorted((i, len(ids[i]), digest(np.array(ids[i], "<u4").tobytes()), digest(alive[i].encode())) for i, n in want.items() for _ in range(n))
    assert sorted(tuple(r) for r in got) == expected
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == expected


def test_pipeline_edges(spark, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")}))
    odd = odd.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**6), "text": F.lit(None).cast("string")})).withColumns({"_lines": F.lit(1), "component_id": F.lit(2), "copies": F.lit(3), "score": F.lit("x")})
    for name, rows in {"odd": odd, "none": odd.limit(0)}.items():
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = rows
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = f(spark, kept, f"{tmp_path}/{name}")
            assert kept.columns == rows.columns, stage
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_one_long_text_does_not_end_the_toxicity_sample(spark, monkeypatch):
    """The row of the first hash is longer than a row may be, and a later one than the room left; those behind them still count."""
    texts = [(i, f"calm words here {i % 7}. " + ("you vileword now. " if i % 3 == 0 else "fine day. ") + "calm end.") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    first = docs.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).first()["doc_id"]
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("long words without end "), 20_000)).otherwise(F.col("text")))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    monkeypatch.setattr(toxicity, "ROW_BYTES", 20_000)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, F.lit(True)).collect()}
    assert all((r["score"] >= toxicity.THRESHOLD) == (i % 3 == 0) for i, r in got.items() if i != first)
    text = dict(texts)
    hit = next(i for i in got if i % 3 == 0 and i != first)
    assert [text[hit][s["start"] :].startswith("you vileword now") for s in got[hit]["offending"]] == [True]


def test_quality_scores_equal_a_plain_vote(spark):
    """Every score of the whole small table: all cosines with all voters, sorted, the nearest fifteen weighed by hand."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    learned = sorted((str(i), i) for i in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1)
    terms = np.array([quality_classifier.term_vector(docs[i]).astype(np.float32) for _, i in learned], float)
    mean, space = quality_classifier.fit_space(terms)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    voters = [(unit((t - mean) @ space), labels[i]) for t, (_, i) in zip(terms, learned, strict=True)]
    for r in queries.QUERIES["op4_quality_classifier"](spark, SMALL).collect():
        own = unit((quality_classifier.term_vector(docs[r["doc_id"]]) - mean) @ space)
        nearest_first = sorted(((float(own @ v), y) for v, y in voters), key=lambda x: -x[0])[: quality_classifier.NEIGHBOURS]
        weights = [max(c, 1e-6) ** quality_classifier.POWER for c, _ in nearest_first]
        assert r["score"] == pytest.approx(sum(w * y for w, (_, y) in zip(weights, nearest_first, strict=True)) / sum(weights), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_toxicity_equals_a_plain_noisy_or(spark, monkeypatch):
    """Every score of the whole small table from the fitted weights, sentence by sentence."""
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda *a, f=toxicity.fit, **k: fitted.append(f(*a, **k)) or fitted[-1])
    found = {r["doc_id"]: r for r in queries.QUERIES["op7_toxicity"](spark, SMALL).collect()}
    weight, bias = fitted[0]
    assert np.count_nonzero(weight) > 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        innocent = 1.0
        for sentence in re.split(r"[.!?\n]", (r["text"] or "").lower()):
            words = set(re.findall(r"\w+", sentence))
            if words:
                logit = bias + sum(weight[t] for w in words for t in toxicity.word_terms(w))
                innocent *= 1 - 1 / (1 + math.exp(-max(-30, min(30, logit))))
        assert found[r["doc_id"]]["score"] == pytest.approx(1 - innocent, abs=1e-9)


def test_wide_vectors(spark, monkeypatch):
    """Wide vectors lie in shards of few nodes, are copied a few at once, and are found like others."""
    monkeypatch.setattr(nearest, "SHARD_BYTES", 1 << 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 1_024)).astype(np.float32).astype(float)
    assert nearest.deal([(1_024, 0, len(x))]) == [(1_024, 0, 0, 3)]
    graph = hnsw.build(hnsw.linked(x))
    monkeypatch.setattr(hnsw, "COPIED", 5_000)
    few = hnsw.build(hnsw.linked(x))
    assert graph.keys() == few.keys() and all(np.array_equal(graph[n], few[n]) for n in graph)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict = {}
    for r in nearest.nearest(df, F.col("id") % 60 == 0, k=5).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(found) == [0, 60, 120, 180, 240]
    for q, got in found.items():
        products = x @ x[q]
        products[q] = -np.inf
        assert len(set(got) & set(np.argsort(-products)[:5].tolist())) >= 4
