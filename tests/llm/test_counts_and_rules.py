"""Quality rules, token counts, BPE and URL rules against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from conftest import SMALL, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tuneline.llm import bpe, lexicon, quality_rules, queries, token_counts, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
EDGES = [None, "", " ", "\n\n", "a", "a b c", "x" * 5000, "é漢😀 ²½ \x00\x1c", "the the the " * 400, "a  b\t\tc \n d", "<|endoftext|>x<|endoftext|>", "▁a ▁", "Same line here.\nSame line here.\n\nSame line here."]


def _docs(spark, texts=EDGES):
    return spark.createDataFrame([(i, t, "keep me") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else set()
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rule_features_equal_brute_force(spark):
    rng = random.Random(2)
    texts = EDGES + [" ".join(rng.choice("ab|#. éX") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        f = dict(zip(quality_rules.FEATURES, quality_rules.text_features(t), strict=True))
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == _base(t)


def test_rules_query(spark):
    got = queries.QUERIES["op2_quality_rules"](spark, SMALL).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        n, chars, symbols, dup, repeat = _base(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dup)
        assert r["base_failed"] == (n < 20 or 100 * r["n_repeat_words"] > 30 * n) and not (r["kept"] and r["base_failed"])
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    junk = [r["kept"] for r in got if quality.get(r["doc_id"]) == 0]
    good = [r["kept"] for r in got if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(junk) <= 0.2 * len(junk) and sum(good) >= 0.95 * len(good)


def test_votes_find_what_rules_agree_on():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    vote = lambda right, cover: np.where(rng.random(4000) < cover, np.where(rng.random(4000) < right, np.where(good, 1, -1), np.where(good, -1, 1)), 0)
    patterns, counts = np.unique(np.stack([vote(0.95, 0.9), vote(0.9, 0.8), vote(0.7, 0.6)], 1), axis=0, return_counts=True)
    _, accuracy, prior = quality_rules.fit_votes(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.08 and accuracy[0] > accuracy[2]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_planted_accuracies_are_found(seed):
    rng, n = np.random.default_rng(seed), 60_000
    good, planted = rng.random(n) < 0.8, [0.55, 0.6, 0.7, 0.8, 0.9, 0.95, 0.95]
    held = np.stack([np.where(rng.random(n) < 0.8, np.where((rng.random(n) < a) == good, 1, -1), 0) for a in planted], 1)
    patterns, counts = np.unique(held, axis=0, return_counts=True)
    _, accuracy, prior = quality_rules.fit_votes(patterns, counts.astype(float))
    assert np.abs(accuracy - planted).max() <= 0.05 and abs(prior - 0.8) <= 0.05


@pytest.mark.parametrize("misfires", [0.02, 0.3, 0.5])
@pytest.mark.parametrize("times", [1, 1000])
def test_a_misfiring_rule_loses_its_say(misfires, times):
    rng, n = np.random.default_rng(1), 50_000
    bad = rng.random(n) < 0.15
    held = np.zeros((n, 9), int)
    for r in range(8):
        held[rng.random(n) < np.where(bad, 0.35, 0.005), r] = -1
    held[rng.random(n) < misfires, 0] = -1
    held[rng.random(n) < np.where(bad, 0.3, 0.9), 8] = 1
    patterns, counts = np.unique(held, axis=0, return_counts=True)
    post, accuracy, prior = quality_rules.fit_votes(patterns, counts.astype(float) * times)
    right = bad[held[:, 0] < 0].mean()
    assert abs(accuracy[0] - right) < 0.1 and (accuracy[1:8] > 0.85).all() and abs(prior - 0.85) < 0.02
    of = lambda *bad_rules, good: post[(patterns == [-(r in bad_rules) for r in range(8)] + [int(good)]).all(1)][0]
    # One bad vote passes against a good one; two of sound rules don't.
    assert of(0, good=True) > 0.5 and of(1, good=True) > 0.5 and of(1, 2, good=True) < 0.5


def test_rules_edges(spark):
    out = quality_rules.judge(_docs(spark).drop("n_words"))
    assert out.count() == len(EDGES) and out.where("n_words = 0").count() == 4
    assert quality_rules.judge(_docs(spark).drop("n_words").limit(0)).count() == 0
    with pytest.raises(ValueError, match="missing"):
        quality_rules.judge(spark.range(1))


@pytest.fixture(scope="module")
def pieces():
    return token_counts.PieceLengths(public_tokenizers.path(token_counts.MODEL))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ab▁é\n\t漢<s>.0\x00 ​"), max_size=40))
def test_piece_lengths(text):
    held = token_counts._model(public_tokenizers.path(token_counts.MODEL))
    assert held.splits and held.lengths([text]) == [len(held.model.encode(text))]


def test_token_counts(spark, pieces):
    docs = _docs(spark)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, public_tokenizers.path(token_counts.MODEL), limit=100).collect()}
    for i, t in enumerate(EDGES):
        n = len(pieces.model.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(docs.limit(0), public_tokenizers.path(token_counts.MODEL)).count() == 0


def test_long_texts_are_cut_safely(pieces):
    text = "ab  cd e " * 3000
    for most in (7, 50, 1000):
        parts = token_counts.segments(text, most)
        assert "".join(parts) == text
        assert sum(pieces.lengths([p if i == 0 else p[1:]])[0] if p != " " or i == 0 else 1 for i, p in enumerate(parts)) == len(pieces.model.encode(text))


@pytest.fixture(scope="module")
def vocabulary():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(bpe.VOCABULARY)
    return bpe.ByteBpe(path), Tokenizer.from_file(path)


def _lexicon(tmp_path, own, words):
    spelled = sorted({w.encode() for w in words})
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.compile_words(spelled, *own.merge_all([w.decode() for w in spelled])))
    return lexicon.Lexicon(str(path)), spelled


def test_lexicon_numbers_words(tmp_path, vocabulary):
    held, words = _lexicon(tmp_path, vocabulary[0], ["a", "ab", "abc", "b", "bc", " the", " then", "é", "tion", "ation"])
    assert held.ranks(words).tolist() == list(range(len(words)))
    assert held.ranks([b"", b"abcd", b"zz", b"t"]).tolist() == [-1] * 4
    assert len(held.accept) < sum(map(len, words))
    none, _ = _lexicon(tmp_path, vocabulary[0], [])
    assert none.ranks([b"a"]).tolist() == [-1]


def test_encoding_equals_the_library(tmp_path, vocabulary):
    own, theirs = vocabulary
    held, _ = _lexicon(tmp_path, own, ["the", " the", "ation", " 1"])
    rng = random.Random(4)
    parts = ["the", " the", "ation", " ", "  ", "\n", "'s", "'LL", "é", "²", "1", "_", "-", "<|endoftext|>", "漢", "\x1c", "\xa0", "Ⅷ", "́", "😀", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["ab" * 3000, "a" * 4000, " " * 3000 + "x", "".join(rng.choice(string.ascii_letters) for _ in range(3000)), ""]
    texts += [f"a{chr(k)}b {chr(k)} {chr(k)}1" for k in range(0x3000)]
    ids, ends = own.encode_batch(texts, held)
    for t, i, j in zip(texts, ends[:-1], ends[1:], strict=True):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ids[i:j].tolist() == want, repr(t[:60])
        assert own.decode(ids[i:j]).decode("utf-8", "replace") == theirs.decode(want, skip_special_tokens=False)


def test_bpe_query_and_round_trip(spark, vocabulary):
    theirs = vocabulary[1]
    path = public_tokenizers.path(bpe.VOCABULARY)
    docs = _docs(spark)
    got = bpe.encode(docs, path, decode=True)
    for r in got.collect():
        text = EDGES[r["doc_id"]] or ""
        want = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want) and r["decoded"] == text
    assert rows(bpe.decode(got, path)) == rows(got.select("doc_id", "decoded"))
    assert bpe.encode(docs.limit(0), path).count() == 0
    sums = {r["doc_id"]: r for r in queries.QUERIES["op3_bpe"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        want = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        assert sums[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert sums[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_url_rules(spark, duck):
    assert rows(queries.QUERIES["op10_url_filter"](spark, SMALL)) == rows(duck.sql(queries.ORACLE_SQL["op10_url_filter"]))
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://notexample.com/en/", "http://a.net/fr/1?x#y", "ftp://a.net?/fr/", "x://y://z.com/", "http://casino.org/", "http://m.casino-win.net/es/"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id int, url string, _fits string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[5] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[6] == ("notexample.com", "/en/", "com/", "allow")
    assert got[7] == ("a.net", "/fr/1", "net/fr/", "block") and got[8][:2] == ("a.net", "") and got[9][0] == "y:"
    assert got[10][3] == "block" and got[11] == ("m.casino-win.net", "/es/", "net/es/", "block")
    assert url_filter.judge_urls(pages, url_filter.RULES).where(F.col("_fits") == "own").count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_unspaced_texts_stay_out_of_the_lexicon(spark, vocabulary):
    """Words without end are neither counted nor collected, and merged exactly; frequent words are taken up to a bound in bytes."""
    rng = random.Random(4)
    path = public_tokenizers.path(bpe.VOCABULARY)
    texts = ["".join(rng.choices("abcdefghij", k=1_000_000)) for _ in range(3)] * 4 + ["the frequent words and the rest"] * 5 + ["é" * 33 + " " + "é" * 32]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = bpe.frequent_words(docs, path)
    assert b" the" in words and max(map(len, words)) <= bpe.WORD_BYTES and sum(map(len, words)) <= bpe.LEXICON_BYTES
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode(docs, path).collect()}
    for i in (0, 1, 2, 12, 17):
        assert got[i] == vocabulary[1].encode(texts[i], add_special_tokens=False).ids


def test_lexicon_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a a a a a a a bb bb bb bb longer longer x")], "doc_id long, text string")
    path = public_tokenizers.path(bpe.VOCABULARY)
    assert bpe.frequent_words(docs, path) == sorted([b"a", b" a", b" bb", b" longer", b" x"])
    monkeypatch.setattr(bpe, "LEXICON_BYTES", 6)
    assert bpe.frequent_words(docs, path) == [b" a", b" bb"]


def test_token_counts_query_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.QUERIES["op5_token_counts"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        n = len(model.encode(r["text"] or ""))
        assert found[r["doc_id"]] == (len((r["text"] or "").encode()), n, n > 4096)


def test_posterior_equals_a_plain_expectation_maximisation():
    """The same model in loops over patterns, rules and votes, on random tables."""
    rng = np.random.default_rng(6)
    for _ in range(5):
        patterns = np.unique(rng.integers(-1, 2, (12, 4)), axis=0)
        counts = rng.integers(1, 400, len(patterns)).astype(float)
        rules, votes, trust, weight = range(4), (-1, 0, 1), 0.95, 100
        post = [1 / (1 + math.exp(-sum(p))) for p in patterns.tolist()]
        cast = [[counts[patterns[:, r] == v].sum() for v in votes] for r in rules]
        cast = [[c * weight / max(row[0] + row[2], 1) for c in row] for row in cast]
        prior = 0.5
        for _ in range(1000):
            good = sum(c * p for c, p in zip(counts, post, strict=True))
            prior = (good + 1) / (counts.sum() + 2)
            chance = {}
            for r in rules:
                for of in (0, 1):
                    belief = {-1: 1 - trust if of else trust, 0: prior if of else 1 - prior, 1: trust if of else 1 - trust}
                    total = [sum(c * (q if of else 1 - q) for c, q, p in zip(counts, post, patterns, strict=True) if p[r] == v) + cast[r][i] * belief[v] + 1e-6 for i, v in enumerate(votes)]
                    for v, n in zip(votes, total, strict=True):
                        chance[r, of, v] = n / sum(total)
            new = []
            for p in patterns.tolist():
                odds = math.log(prior / (1 - prior)) + sum(math.log(chance[r, 1, p[r]]) - math.log(chance[r, 0, p[r]]) for r in rules)
                new.append(1 / (1 + math.exp(-max(-60, min(60, odds)))))
            moved, post = max(abs(a - b) for a, b in zip(new, post, strict=True)), new
            if moved < 1e-9:
                break
        got, _, share = quality_rules.fit_votes(patterns, counts)
        assert np.allclose(got, post, atol=1e-6) and abs(share - prior) < 1e-6


def test_columns_of_clashing_names_and_long_values(spark):
    docs = spark.createDataFrame([(1, "some good words here. and more of them.", 7, 0.1, "x"), (2, None, 7, 0.1, "x")], "doc_id long, text string, n_words int, quality double, _text string")
    judged = quality_rules.judge(docs).collect()
    assert {r["doc_id"]: r["n_words"] for r in judged} == {1: 8, 2: 0} and all(0 <= r["quality"] <= 1 for r in judged)
    urls = [(1, "http://example.com/en/" + "a" * 1_000_000), (2, "x" * 100_000 + "://m.example.com/en/"), (3, "http://" + "s." * 300 + "net/fr/")]
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in urls], "page_id long, url string, token string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.RULES).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("example.com/en/", "block"), 3: ("net/fr/", "block")}
