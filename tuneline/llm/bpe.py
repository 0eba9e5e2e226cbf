"""Byte-level BPE encoding and decoding with a word lexicon.

The frequent words of the corpus (counted over every document) are compiled, with their
ids, into a minimal acyclic transducer that executors memory-map. A batch's distinct words
walk it together; the words it lacks are merged exactly, by rank. Merging can't cross word
boundaries, so a text's ids are those of its words in turn.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneline.llm.common import table
from tuneline.llm.lexicon import Lexicon, compile_words
from tuneline.session import materialize, require_columns, share_file

VOCABULARY = "byte_bpe_50k.json"
#: Most words of the lexicon, which the driver compiles, their bytes in all, and bytes of one; longer words are rare and merged exactly.
LEXICON_WORDS, LEXICON_BYTES, WORD_BYTES = 100_000, 2 << 20, 64
#: Characters of text that one step encodes, and counted words that a task holds before it passes them on.
BATCH_CHARS, HELD_WORDS = 4 << 20, 300_000
#: Bytes beyond which a word is merged by itself.
LONG_WORD = 512
_NO_RANK = 1 << 40

# The word pattern of byte-level BPE vocabularies of this kind.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERN = _CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over characters for which the standard library's classes agree with Unicode's.
_QUICK = re.compile(_CONTRACTIONS + r"| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ȟ‐-‧]")


@lru_cache(maxsize=1)
def _slow():
    import regex

    return regex.compile(_PATTERN)


def split_words(text: str) -> list[str]:
    return (_slow() if _OTHER.search(text) else _QUICK).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's file format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        pre, model = held["pre_tokenizer"], held["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or held["normalizer"] or not pre.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        vocab, letters = model["vocab"], _byte_letters()
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        spelled = [b""] * size
        for t, i in vocab.items():
            spelled[i] = bytes(map(letters.__getitem__, t))
        for t, i in self.special.items():
            spelled[i] = t.encode()
        self.starts = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in spelled], out=self.starts[1:])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        order = sorted(self.pairs)
        self.pair_keys = np.array([(a << 32) | b for a, b in order], np.int64)
        self.pair_ranks = np.array([self.pairs[p][0] for p in order], np.int64)
        self.pair_ids = np.array([self.pairs[p][1] for p in order], np.int64)
        self.of_byte = np.array(self.single, np.int64)

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if self._special is None or not any(s in text for s in self.special):
            return split_words(text)
        return [w for part in self._special.split(text) for w in ([part] if part in self.special else split_words(part))]

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has.

        Every round merges, in each word that still has a pair, all places of its pair of
        lowest rank, from the left. Words finish and leave; only pairs beside a merge are
        looked up again.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        alone: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.special:
                alone[i] = [self.special[w]]
            elif len(raw[i]) > LONG_WORD:
                alone[i] = self._merge_long([self.single[b] for b in raw[i]])
        for i in alone:
            raw[i] = b""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        rank, made = self._look_up(ids, owner, np.arange(len(ids)))
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            width = np.diff(np.append(starts, len(ids)))
            open_ = np.repeat(least < _NO_RANK, width)
            if not open_.all():
                done_ids.append(ids[~open_])
                done_owner.append(owner[~open_])
                least, width = least[least < _NO_RANK], width[least < _NO_RANK]
                ids, owner, rank, made = ids[open_], owner[open_], rank[open_], made[open_]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, width))
            # Of places that touch (a a a), every second one from the left.
            run = np.append(True, np.diff(at) != 1)
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, owner, rank, made = ids[keep], owner[keep], rank[keep], made[keep]
            touched = np.zeros(len(ids), bool)
            touched[moved] = True
            touched[np.maximum(moved - 1, 0)] = True
            near = np.flatnonzero(touched)
            rank[near], made[near] = self._look_up(ids, owner, near)
        for i, own in alone.items():
            done_ids.append(np.array(own, np.int64))
            done_owner.append(np.full(len(own), i))
        if not done_ids:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        all_ids, all_owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return all_ids[np.argsort(all_owner, kind="stable")].astype(np.uint32), np.bincount(all_owner, minlength=len(words))

    def _look_up(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at ``at``; no rank at a word's end."""
        then = np.minimum(at + 1, len(ids) - 1)
        key = (ids[at] << 32) | ids[then]
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[found] == key) & (owner[at] == owner[then]) & (then > at)
        return np.where(hit, self.pair_ranks[found], _NO_RANK), self.pair_ids[found]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long word, with a heap over a linked list."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*self.pairs[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heap = [(rank, i, new, p) for rank, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, p = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ids[i] < 0 or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for a in (left[i], i):
                if a >= 0 and (b := right[a]) >= 0 and (q := (ids[a], ids[b])) in self.pairs:
                    rank, made = self.pairs[q]
                    heapq.heappush(heap, (rank, a, made, q))
        return [x for x in ids if x >= 0]

    def encode_batch(self, texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids begin (one more entry for the end)."""
        number: dict[str, int] = {}
        used, ends = [], []
        for t in texts:
            used += [number.setdefault(w, len(number)) for w in self.split(t)]
            ends.append(len(used))
        words = list(number)
        rank = lexicon.ranks([w.encode("utf-8", "surrogatepass") for w in words])
        rest = np.flatnonzero(rank < 0)
        merged, counts = self.merge_all([words[i] for i in rest])
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        in_book = np.flatnonzero(rank >= 0)
        first[in_book] = lexicon.starts[rank[in_book]]
        size[in_book] = lexicon.starts[rank[in_book] + 1] - first[in_book]
        size[rest] = counts
        first[rest] = len(lexicon.ids) + np.cumsum(counts) - counts
        pool = np.concatenate([lexicon.ids, merged])
        used = np.array(used, np.int64)
        ids = pool[ragged(first[used], size[used])]
        total = np.concatenate([[0], np.cumsum(size[used])])
        return ids.astype("<u4"), total[np.array([0, *ends])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` spell."""
        first = self.starts[ids]
        return self.bytes[ragged(first, self.starts[ids.astype(np.int64) + 1] - first)].tobytes()


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices first[0], first[0]+1, ... (size[0] of them), first[1], ... in one array."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=2)
def _lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def _count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, held = _vocabulary(path), Counter()

        def out() -> pa.RecordBatch:
            words = [w.encode("utf-8", "surrogatepass") for w in held]
            b = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return b.filter(pa.array([len(w) <= WORD_BYTES for w in words], pa.bool_()))

        for b in batches:
            for x in b.column(0):
                words = bpe.split(x.as_py() or "")
                # No longer word is held, so what a task holds is bounded in bytes.
                held.update(words if max(map(len, words), default=0) <= WORD_BYTES else [w for w in words if len(w) <= WORD_BYTES])
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return run


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS, text_col: str = "text") -> list[bytes]:
    """The most frequent words of up to WORD_BYTES over all documents, at most ``most`` and LEXICON_BYTES of them, in byte order.

    A histogram of counts in steps of an eighth of a power of two (a few hundred rows) gives
    the least count to keep, so that no more words, and bytes, than that reach the driver.
    """
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_words(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "words")
    left, room, least = most, LEXICON_BYTES, None
    for r in sorted(counts.groupBy("step").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("bytes")).collect(), key=lambda r: -r["step"]):
        left, room = left - r["words"], room - r["bytes"]
        if left < 0 or room < 0:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in counts.where(F.col("step") >= least).select("word").collect())


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile the frequent words into a file of the shared folder that all executors get; returns its name there."""
    bpe = ByteBpe(path)
    special = {s.encode() for s in bpe.special}
    words = [w for w in frequent_words(docs, path, most, text_col) if w and w not in special]
    ids, sizes = bpe.merge_all([w.decode("utf-8", "surrogatepass") for w in words])
    data = compile_words(words, ids, sizes)
    # A name is registered once in a session, so each compilation has its own.
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    share_file(docs.sparkSession, name, data)
    return name


def _coder(path: str, name: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon = _vocabulary(path), _lexicon(SparkFiles.get(name))
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, size = [], 0
                while at + len(texts) < b.num_rows and size < BATCH_CHARS:
                    texts.append(b.column(1)[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                end = at + len(texts)
                ids, ends = bpe.encode_batch(texts, lexicon)
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                columns = [b.column(0).slice(at, end - at), pa.array(np.diff(ends)), pa.array([ids[i:j].tobytes() for i, j in spans], pa.binary())]
                if decode:
                    columns.append(pa.array([bpe.decode(ids[i:j]).decode("utf-8", "replace") for i, j in spans], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_tokens", "ids", "decoded"][: len(columns)])
                at = end

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: str | None = None, decode: bool = False) -> DataFrame:
    """One row a document: id, n_tokens, ids (little-endian unsigned 32-bit integers) and, if asked for, decoded (the text that the ids spell).

    A null text counts as an empty one, which has no ids. Special tokens inside a text get
    their ids. Repeated rows are encoded each; texts are read whole, however long and with or without blanks; further
    columns are ignored, whatever their names; an empty table gives an empty table.
    """
    require_columns(docs, id_col, text_col)
    lexicon = lexicon or build_lexicon(docs, path, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, ids binary" + ", decoded string" * decode
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_coder(path, lexicon, decode), schema)
    return rows.withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row an encoded row: id and decoded; null ids spell nothing, and bytes that aren't UTF-8 become U+FFFD."""
    require_columns(encoded, id_col, ids_col)

    def run(batches):
        bpe = _vocabulary(path)
        for b in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["_id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, f"_id {kind}, decoded string").withColumnRenamed("_id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    """Encode, decode, and give each document's token count and digests of its ids and decoded text."""
    import public_tokenizers

    done = encode(docs, public_tokenizers.path(VOCABULARY), decode=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
