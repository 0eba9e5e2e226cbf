"""Toxicity by multiple-instance learning.

Only documents have labels. A document is a bag of sentences; each sentence has a
probability of its own (logistic, over hashed words and word beginnings), and the document
is toxic if any sentence is (noisy-or). Training through the noisy-or teaches the
sentence model, which then also says where the offence is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.llm.common import held_out, labelled_sample, table
from tuneline.session import materialize, require_columns

#: Most labelled rows of each label that the model is fitted on.
SAMPLE = {1: 2_000, 0: 4_000}
#: Hashed terms (a power of two), lengths of word beginnings that are terms beside the whole word.
TERMS, BEGINNINGS = 1 << 18, (4, 5, 6, 7)
PER_WORD = 1 + len(BEGINNINGS)
#: Start of the bias: a sentence is innocent until shown otherwise.
INNOCENT = -5.0
THRESHOLD = 0.3
#: Bytes of term numbers of the labelled rows that the driver gets, and of one row; in the order of the hashes of their ids,
#: a row that is longer, or for which there is no room left, is left out of the fit, and those behind it aren't.
SAMPLE_BYTES, ROW_BYTES = 40 << 20, 2 << 20

_TOKEN = re.compile(r"\w+|[.!?\n]")
_END = re.compile(r"[.!?\n]")


def word_terms(word: str) -> list[int]:
    """The word's terms: itself and its beginnings (of a shorter word, all of it)."""
    spelled = [word + "$", *(word[:n] for n in BEGINNINGS)]
    return [zlib.crc32(s.encode("utf-8", "surrogatepass")) & (TERMS - 1) for s in spelled]


def number_words(text: str | None, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the text's words in ``number`` (which grows) and the sentence that each is in."""
    found = _TOKEN.findall((text or "").lower())
    ids = np.array([number.setdefault(w, len(number)) for w in found], np.int64)
    ends = [number[c] for c in ".!?\n"]
    is_end = (ids == ends[0]) | (ids == ends[1]) | (ids == ends[2]) | (ids == ends[3])
    return ids[~is_end], np.cumsum(is_end)[~is_end]


def _numbered() -> dict[str, int]:
    return {c: i for i, c in enumerate(".!?\n")}


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prevalence: float, rounds: int = 100, rate: float = 0.1, sparsity: float = 1.5e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that make the noisy-or of sentences fit the documents' labels.

    A bag is its term numbers, PER_WORD of them a word, and each word's sentence. Adam over
    the whole sample, with soft thresholding that leaves most weights zero. The labels weigh
    as ``prevalence`` says, so that scores are probabilities in the table and not in the sample.
    """
    weight, bias = np.zeros(TERMS), INNOCENT
    if not len(bags) or labels.min(initial=1) == labels.max(initial=0):
        return weight, bias
    of, sizes, base = [], [], 0
    for _, sentence in bags:
        _, dense = np.unique(sentence, return_inverse=True)
        of.append((np.repeat(dense, PER_WORD) + base).astype(np.int32))
        sizes.append(int(dense.max(initial=-1)) + 1)
        base += sizes[-1]
    terms, of_term, owner = np.concatenate([t for t, _ in bags]), np.concatenate(of), np.repeat(np.arange(len(bags)), sizes)
    slot = np.zeros(TERMS, np.int32)
    slot[terms] = 1
    used = np.flatnonzero(slot)
    slot[used] = np.arange(len(used))
    terms = slot[terms]
    # Occurrences lie by sentence, and a second time by term, so that both sums are runs of neighbours.
    by_term = of_term[np.argsort(terms, kind="stable")]
    term_starts, sentence_starts = (np.append(0, np.cumsum(np.bincount(x))[:-1]) for x in (terms, of_term))
    w, first, second = np.append(np.zeros(len(used)), bias), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    share = np.where(labels == 1, prevalence / (labels == 1).sum(), (1 - prevalence) / (labels == 0).sum())
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[terms], sentence_starts) + w[-1], -30, 30)))
        clean = np.bincount(owner, np.log1p(-p), len(bags))
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        slope = p * np.where(labels == 1, -np.exp(clean) / toxic, 1.0)[owner] * share[owner]
        grad = np.append(np.add.reduceat(slope[by_term], term_starts), slope.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = rate / (np.sqrt(second / (1 - 0.99**t)) + 1e-5)
        w -= step * first / (1 - 0.9**t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * sparsity, 0)
    weight[used] = w[:-1]
    return weight, float(w[-1])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        number = _numbered()
        rows = [number_words(x.as_py(), number) for x in b.column(0)]
        terms = np.array([word_terms(w) for w in number], "<i4").reshape(-1, PER_WORD)
        # A word that a sentence repeats counts once, in training as in scoring.
        once = [np.unique(np.stack([s, w], 1), axis=0) for w, s in rows]
        packed = [[terms[o[:, 1]].tobytes() for o in once], [o[:, 0].astype("<i4").tobytes() for o in once]]
        yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.binary()) for p in packed), b.column(1), b.column(2)], ["terms", "sentences", "label", "key"])


class SentenceModel:
    """Scores of sentences and their noisy-or."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def word_weights(self, words: list[str]) -> np.ndarray:
        terms = np.array([word_terms(w) for w in words], np.int64).reshape(-1, PER_WORD)
        return self.weight[terms].sum(1)

    def sentences(self, ids: np.ndarray, sentence: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentence numbers that have words, and their probabilities."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0)
        key = np.unique(sentence * (1 << 32) + ids)
        own, ids = key >> 32, key & ((1 << 32) - 1)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        logit = np.add.reduceat(weights[ids], starts) + self.bias
        return own[starts], 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None) -> DataFrame:
    """One row a document: id, score (0 to 1), offending, n_offending, worst_score, worst_sentence and worst_start.

    offending is an array of (start, score) of the sentences of probability 0.5 or more, in their order, start counted in
    characters, n_offending its size. worst_sentence is the text of the likeliest sentence where the score reaches THRESHOLD, and
    worst_start the characters before it; else null. Of equally likely ones it is the first. Empty and
    null texts, which have no sentence, score 0. Texts are read whole, however long. Repeated rows score
    alike; without labels of both kinds scores are those of the innocent start; an empty table gives an
    empty table. Other columns are ignored, whatever their names.
    """
    require_columns(docs, id_col, text_col)
    require_columns(labels, id_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, sample or SAMPLE, learn_from)
    packed = rows.select("_text", "_label", "_key").mapInArrow(_bags, f"terms binary, sentences binary, label int, key {kind}")
    packed = materialize(packed.withColumn("order", F.xxhash64(F.col("key").cast("string"))), "bags")
    picked, left = [], SAMPLE_BYTES
    for order, n in sorted(tuple(r) for r in packed.select("order", F.length("terms")).collect()):
        if n <= min(left, ROW_BYTES):
            picked.append(order)
            left -= n
    # One row of each sampled id was packed, so there are no more numbers than the sample has rows.
    got = packed.where(F.col("order").isin(picked)).drop("order").collect() if picked else []
    got.sort(key=lambda r: (str(r["key"]), r["terms"]))
    bags = [(np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["sentences"], "<i4")) for r in got]
    share = labels.where(learn_from).agg(F.avg(F.col(label_col).cast("double"))).first()[0] or 0.0
    known = docs.sparkSession.sparkContext.broadcast(fit(bags, np.array([r["label"] for r in got], int), share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SentenceModel(*known.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                texts = b.column(1).to_pylist()
                number = _numbered()
                found = [number_words(t, number) for t in texts]
                weights = model.word_weights(list(number))
                out = []
                for t, (ids, sentence) in zip(texts, found, strict=True):
                    own, p = model.sentences(ids, sentence, weights)
                    total = float(-np.expm1(np.log1p(-p).sum())) if len(p) else 0.0
                    worst = int(np.argmax(p)) if len(p) else -1
                    text, start, found_at = None, None, []
                    if total >= THRESHOLD or (p >= 0.5).any():
                        split = _END.split(t)
                        begins = np.cumsum([0, *(len(x) + 1 for x in split)]) + np.array([*(len(x) - len(x.lstrip()) for x in split), 0])
                        found_at = [{"start": int(begins[own[i]]), "score": float(p[i])} for i in np.flatnonzero(p >= 0.5)]
                        if total >= THRESHOLD:
                            text, start = split[own[worst]].strip(), int(begins[own[worst]])
                    out.append((min(1.0, max(0.0, total)), found_at, len(found_at), float(p[worst]) if len(p) else 0.0, text, start))
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                kinds = (pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())])), pa.int64(), pa.float64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_id", "score", "offending", "n_offending", "worst_score", "worst_sentence", "worst_start"])

    held = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return held.mapInArrow(run, f"_id {kind}, score double, offending array<struct<start:bigint,score:double>>, n_offending long, worst_score double, worst_sentence string, worst_start long").withColumnRenamed("_id", id_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending", F.array_join(F.transform("offending", lambda x: x["start"].cast("string")), ",").alias("offending_starts"), "worst_start", F.length("worst_sentence").alias("worst_length"))
