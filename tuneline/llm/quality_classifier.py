"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space.

Term vectors (hashed byte pairs and shares of repeated words, windows and lines) of a
bounded labelled sample give, by singular value decomposition, a latent space. The
sample's latent vectors are broadcast; every document's is multiplied with all of them,
block by block, and the labels of its nearest ones vote with the cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.llm.common import held_out, labelled_sample, table
from tuneline.llm.quality_rules import text_features
from tuneline.session import require_columns

#: Most labelled rows of each label that the space is fitted on and that vote.
SAMPLE = 2_000
#: Hashed pairs of bytes, latent dimensions, voters of a document, power of the cosine that weighs a vote.
PAIRS, LATENT, NEIGHBOURS, POWER = 1024, 48, 15, 8
#: Documents whose products are taken at once.
BLOCK = 512
#: Weight of a share of words or lines against the shares of byte pairs.
SHARE_WEIGHT = 0.6
TERMS = PAIRS + 7


def term_vector(text: str | None) -> np.ndarray:
    """Square roots of the shares of terms (so that common terms don't drown rare ones)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS)
    codes = np.frombuffer(raw, np.uint8).astype(np.int32)
    if len(codes) > 1:
        pairs = (codes[:-1] * 40503 + codes[1:] * 10007) >> 3
        out[:PAIRS] = np.bincount(pairs & (PAIRS - 1), minlength=PAIRS) / (len(codes) - 1)
    n_words, _, n_symbols, n_dup, n_repeat, n_lines, n_upper, n_letters, n_shouts, _, n_marked = text_features(text)
    words = raw.split()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    share = [n_symbols / max(1, n_words), n_dup / max(1, n_lines), n_repeat / max(1, n_words), n_upper / max(1, n_letters), n_marked / max(1, n_words), same / max(1, n_words), 1 / (1 + n_words)]
    out[PAIRS:] = np.minimum(share, 2)
    out = np.sqrt(out)
    out[PAIRS:] *= SHARE_WEIGHT
    return out


def fit_space(terms: np.ndarray, latent: int = LATENT) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to the strongest right singular vectors of the centred sample."""
    mean = terms.mean(0) if len(terms) else np.zeros(TERMS)
    values, vectors = np.linalg.eigh((terms - mean).T @ (terms - mean))
    return mean, vectors[:, ::-1][:, :latent]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, voters: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Share of the weight of a vector's k nearest voters whose label is 1 (0.5 if there are none)."""
    if not len(voters):
        return np.full(len(vectors), 0.5)
    near = vectors @ voters.T
    k = min(k, len(voters))
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6) ** POWER
    return np.clip((weight * labels[top]).sum(1) / weight.sum(1), 0, 1)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [term_vector(x.as_py()).astype("<f4").tobytes() for x in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1), b.column(2)], ["terms", "label", "key"])


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """One row a document: id, score (0 to 1) and the columns named in ``keep``.

    ``learn_from`` says which rows of ``labels`` may be learned from. Empty and null texts
    have a term vector of their own and get a score like others; repeated rows get equal
    scores; without labelled rows all scores are 0.5; an empty table gives an empty table. Texts are read whole,
    however long; columns that ``keep`` doesn't name are ignored, whatever their names.
    Driver and broadcast hold at most ``sample`` rows of each label.
    """
    require_columns(docs, id_col, text_col, *keep)
    require_columns(labels, id_col, label_col)
    spark = docs.sparkSession
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, {0: sample, 1: sample}, learn_from)
    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted(rows.select("_text", "_label", "_key").mapInArrow(_terms, f"terms binary, label int, key {kind}").collect(), key=lambda r: (str(r["key"]), r["terms"]))
    terms = np.array([np.frombuffer(r["terms"], "<f4") for r in got], float).reshape(-1, TERMS)
    mean, space = fit_space(terms)
    known = spark.sparkContext.broadcast((mean, space, _unit((terms - mean) @ space), np.array([r["label"] for r in got], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, space, voters, own = known.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                found = np.array([term_vector(x.as_py()) for x in part.column("_text")])
                scores = vote(_unit((found - mean) @ space), voters, own)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], names)

    # Positions name the columns inside, so that no name of the caller's can clash.
    kept = [id_col, *(c for c in keep if c != id_col)]
    names = [f"c{i}" for i in range(len(kept))] + ["score"]
    schema = ", ".join([f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, kept, strict=False)] + ["score double"])
    held = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=False)), F.col(text_col).alias("_text"))
    out = held.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, kept, strict=False)), F.col("score").alias(score_col))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    columns = docs.columns
    own = "_" * max(map(len, columns)) + "score"
    out = score(docs, labels, ~held_out("doc_id", 3, 1), keep=tuple(columns), score_col=own)
    return out.where(F.col(own) >= threshold).select(*(F.col(f"`{c}`") for c in columns))
