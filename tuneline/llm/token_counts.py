"""Token counts of a sentencepiece vocabulary, without the tokens.

Texts are split at safe boundaries: before a blank that follows another character. No
piece of the vocabulary may cross such a place (checked when the model is loaded), so the
merges left and right of it never meet and lengths add up. The parts are gathered into
batches of about equal bytes, whatever the lengths of the texts, and each distinct part of
a batch is encoded once. Arrow functions return lengths only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.llm.common import table
from tuneline.session import require_columns

#: Bytes of text that one call encodes.
BATCH_BYTES = 4 << 20
#: Lengths of parts that a worker remembers between batches; beyond it the memory starts anew.
REMEMBER = 600_000
LIMIT = 4096
MODEL = "piece_bpe_32k.model"

_PART = re.compile(r" *[^ ]+| +")
_BLANK = "▁"


class PieceLengths:
    """Lengths that a sentencepiece model gives, counted by parts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        whole = self.model.encode(["a  b", " a", "a "], out_type=str)
        as_is = whole == [[_BLANK + "a", _BLANK, _BLANK + "b"], [_BLANK, _BLANK + "a"], [_BLANK + "a", _BLANK]]
        #: Whether lengths of parts add up to the length of the text.
        self.splits = as_is and not any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces)
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> list[str]:
        """The text's parts, each without the blank that the model puts in front itself."""
        if not self.splits:
            return [text] if text else []
        return _PART.findall(text.replace(_BLANK, " "))

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = list(parts)
        # " x" is encoded as "x": the model puts a blank in front. A lone blank is one piece.
        for p, ids in zip(new, self.model.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1) if new else [], strict=True):
            self.known[p] = len(ids) if p != " " else 1

    def lengths(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text; texts as a whole where parts don't add up."""
        if not self.splits:
            return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []
        split = [self.parts(t) for t in texts]
        self.learn({p for parts in split for p in parts})
        known, extra = self.known, [0] * len(texts)
        for i, parts in enumerate(split):
            # A blank that begins the text is its own, and stays beside the model's.
            if parts and parts[0][0] == " ":
                extra[i] = len(self.model.encode(parts[0])) - known[parts[0]]
        return [sum(map(known.__getitem__, parts)) + e for parts, e in zip(split, extra, strict=True)]


@lru_cache(maxsize=2)
def _model(path: str) -> PieceLengths:
    return PieceLengths(path)


def segments(text: str, most: int) -> list[str]:
    """The text in pieces of about ``most`` characters, cut before a blank that follows another character."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut > 0 and text[cut - 1] in (" ", _BLANK):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def counter(path: str, batch_bytes: int = BATCH_BYTES):
    """A function for mapInArrow: (id, text) to (id, n_bytes, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for b in batches:
            n_bytes, n_tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            held, rows, size = [], [], 0

            def flush() -> None:
                np.add.at(n_tokens, rows, model.lengths(held))  # noqa: B023

            for i, x in enumerate(b.column(1)):
                text = x.as_py() or ""
                n_bytes[i] = len(text.encode("utf-8", "surrogatepass"))
                for k, part in enumerate(segments(text, batch_bytes // 4) if model.splits else [text]):
                    if k and part in (" ", _BLANK):
                        n_tokens[i] += 1
                        continue
                    # Later segments begin with the blank that the model adds.
                    held.append(part[1:] if k else part)
                    rows.append(i)
                    size += len(part.encode("utf-8", "surrogatepass")) if n_bytes[i] != len(text) else len(part)
                    if size >= batch_bytes:
                        flush()
                        held, rows, size = [], [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row a document: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    A null text counts as an empty one, with no bytes and no tokens. Repeated rows are
    counted each, and texts whole, however long; an empty table gives an empty table.
    Further columns are ignored, whatever their names. ``path`` must exist on every executor.
    """
    require_columns(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(counter(path), f"_id {kind}, n_bytes long, n_tokens long")
    return rows.withColumnRenamed("_id", id_col).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
