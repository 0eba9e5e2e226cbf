"""Quality rules as weak supervision.

Each rule votes good (+1) or bad (-1) or abstains (0). Expectation-maximisation over the
counts of vote patterns estimates how each rule votes on good and on bad documents, and
the posterior probability of good decides. A rule's bad vote can be outweighed by good ones,
and a rule that misfires loses its say; only the stated base conditions reject alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.llm.common import table
from tuneline.session import materialize, require_columns

#: Words in a window whose repeats count.
WINDOW = 8
#: Fields that the text pass makes.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_stops", "n_marked")
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_BLANKS = [0x20, *range(0x09, 0x0E)]
_IS_BLANK = np.isin(np.arange(256), _BLANKS)
#: ASCII characters other than letters and digits.
_MARKS = [b for b in range(33, 128) if not chr(b).isalnum()]
_FACTORS = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts named in FEATURES of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    codes = np.frombuffer(raw, np.uint8)
    seen = np.bincount(codes, minlength=256)
    blank = np.append(_IS_BLANK[codes], True)
    ends = np.bincount(codes[~blank[:-1] & blank[1:]], minlength=256)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > WINDOW:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
        if len(number) < len(words):
            ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            ids ^= ids >> np.uint64(29)
            n = len(words) - WINDOW + 1
            keys = sum(ids[i : i + n] * _FACTORS[i] for i in range(WINDOW))
            _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
            twice = times[back] > 1
            if twice.any():
                edges = np.zeros(len(words) + 1, np.int64)
                starts = np.flatnonzero(twice)
                edges[starts] += 1
                edges[starts + WINDOW] -= 1
                repeated = int((np.cumsum(edges[:-1]) > 0).sum())
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    chars = len(raw) - int(seen[0x80:0xC0].sum()) - int(seen[_BLANKS].sum())
    return len(words), chars, int(seen[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated, len(lines), upper, upper + lower, int(seen[33]), int(ends[[33, 46, 63]].sum()), int(ends[_MARKS].sum())


def _features(batches):
    for b in batches:
        rows = [text_features(x.as_py()) for x in b.column(1)]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64()) for _ in FEATURES]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["_id", *FEATURES])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id and FEATURES; a null text counts as an empty one."""
    require_columns(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_features, f"_id {kind}, " + ", ".join(f"{f} long" for f in FEATURES))
    return rows.withColumnRenamed("_id", id_col)


def _vote(bad: Column, good: Column | None = None) -> Column:
    found = F.when(bad, -1)
    return (found if good is None else found.when(good, 1)).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules over FEATURES. Defects vote bad or abstain, since the lack of one defect says little;
    signs of prose vote good. A share with nothing to divide by is null, so its rule abstains."""
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    size, symbols, upper = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_upper", "n_letters")
    repeats, lines, shouts, stops = share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), share("n_shouts", "n_words"), share("n_stops", "n_words")
    marked = share("n_marked", "n_words")
    return {
        "length": _vote(F.col("n_words") < 5),
        "word_size": _vote((size < 2.5) | (size > 11)),
        "sentences": _vote((stops < 0.01) & (F.col("n_words") >= 50), stops.between(0.02, 0.25)),
        "symbols": _vote(symbols > 0.1),
        "marked_words": _vote((marked > 0.4) & (F.col("n_words") >= 20)),
        "upper_case": _vote(upper > 0.4),
        "repeats": _vote(repeats > 0.2),
        "dup_lines": _vote(lines > 0.3),
        "shouting": _vote(shouts > 0.2),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, trust: float = 0.95, votes_of_trust: float = 100, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns. Returns the posterior of good by pattern, each rule's accuracy where it votes, and the share of good.

    ``trust`` is the accuracy that every rule is believed to have beforehand, a belief that
    weighs as much as ``votes_of_trust`` of its votes whatever the size of the table. It fixes
    which class is good and speaks for rules that seldom vote; the others' accuracy comes from
    the table. The start is the sum of votes.
    """
    post = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    outcome = np.stack([patterns == v for v in (-1, 0, 1)], 2)
    seen = np.einsum("p,prv->rv", counts.astype(float), outcome)
    cast = seen * (votes_of_trust / np.maximum(seen[:, [0, 2]].sum(1, keepdims=True), 1))
    accuracy, prior = np.full(patterns.shape[1], trust), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        belief = np.stack([cast * [trust, 1 - prior, 1 - trust], cast * [1 - trust, prior, trust]])
        share = np.einsum("cp,prv->crv", weight, outcome) + belief + 1e-6
        right = (share[1, :, 2] + share[0, :, 0]) / share[:, :, [0, 2]].sum((0, 2))
        share /= share.sum(2, keepdims=True)
        odds = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", outcome, np.log(share[1]) - np.log(share[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        accuracy, moved, post = right, np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            break
    return post, accuracy, float(prior)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document: id, FEATURES, one vote_ column a rule, quality (posterior) and good.

    Empty and null texts have zero counts, on which most rules abstain. Repeated rows are
    judged alike; an empty table gives an empty table. Texts are read whole, however long, and further columns
    are ignored, whatever their names. The driver gets one row for each
    vote pattern there is: 3 to the number of rules (19,683) at most.
    """
    rules = votes()
    codes = {f"vote_{k}": v for k, v in rules.items()}
    seen = materialize(measure(docs, id_col, text_col).withColumns(codes), "votes")
    found = seen.groupBy(*codes).count().collect()
    patterns = np.array([[r[c] for c in codes] for r in found], int).reshape(-1, len(codes))
    post, _, _ = fit_votes(patterns, np.array([r["count"] for r in found], float)) if found else (np.zeros(0), None, 0)
    code = sum(((F.col(c) + 1) * 3**i for i, c in enumerate(codes)), F.lit(0))
    known = seen.sparkSession.createDataFrame([(int(((p + 1) * 3 ** np.arange(len(codes))).sum()), float(q)) for p, q in zip(patterns, post, strict=True)], "_code int, quality double")
    out = seen.withColumn("_code", code.cast("int")).join(F.broadcast(known), "_code").drop("_code")
    return out.withColumn("good", F.col("quality") >= threshold)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = judge(table(spark, sf_dir, "documents")).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("good")).alias("kept"), "quality")
