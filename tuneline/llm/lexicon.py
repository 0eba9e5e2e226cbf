"""A minimal acyclic transducer from words to numbers, in flat arrays.

Words are added in byte order; states with equal futures are shared (incremental
minimisation of sorted input), so suffixes are stored once. Each arc carries the number of
words that sort before every word through it; the outputs along a word's path add up to the
word's rank, which addresses its ids in one flat array. The file is memory-mapped.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

_MAGIC = np.frombuffer(b"WORDFST1", np.uint32)


def compile_words(words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The automaton of ``words`` (sorted, distinct, not empty); ``ids`` are theirs in turn, ``sizes`` how many each has."""
    if any(a >= b for a, b in pairwise(words)):
        raise ValueError("words must be sorted and distinct")
    # A state is [accepts, [(byte, state), ...]]; the path of the last word is still open.
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            accepts, arcs = path.pop()
            key = (accepts, tuple(arcs))
            at = register.get(key)
            if at is None:
                at = register[key] = len(states)
                states.append(key)
            byte, _ = path[-1][1][-1]
            path[-1][1][-1] = (byte, at)

    last = b""
    for w in words:
        same = 0
        while same < len(last) and last[same] == w[same]:
            same += 1
        close(same)
        for byte in w[same:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    # Children come before parents, so one pass counts the words below each state.
    below, keys, targets, outputs = [], [], [], []
    for at, (accepts, arcs) in enumerate(states):
        n = int(accepts)
        for byte, child in arcs:
            keys.append(at * 256 + byte)
            targets.append(child)
            outputs.append(n)
            n += below[child]
        below.append(n)
    starts = np.zeros(len(words) + 1, np.uint32)
    np.cumsum(sizes, out=starts[1:])
    accept = np.array([a for a, _ in states], np.uint32)
    parts = [np.array(x, np.uint32) for x in (keys, targets, outputs)] + [accept, starts, np.asarray(ids, np.uint32)]
    head = np.array([len(states) - 1, *map(len, parts)], np.uint32)
    return b"".join(x.tobytes() for x in (_MAGIC, head, *parts))


class Lexicon:
    """A compiled automaton, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint32, mode="r")
        if not np.array_equal(data[:2], _MAGIC):
            raise ValueError(f"{path} holds no lexicon")
        self.root, at, parts = int(data[2]), 9, []
        for n in data[3:9]:
            parts.append(data[at : at + int(n)])
            at += int(n)
        self.keys, self.targets, self.outputs, self.accept, self.starts, self.ids = parts

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, or -1; all words walk the automaton side by side, a byte a step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, rank, alive = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        out = np.full(len(words), -1, np.int64)
        step = 0
        while len(alive) and len(self.keys):
            done = sizes[alive] == step
            ended = alive[done]
            ended = ended[self.accept[state[ended]] == 1]
            out[ended] = rank[ended]
            alive = alive[~done]
            key = (state[alive] * 256 + codes[starts[alive] + step]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            state[alive] = self.targets[at]
            rank[alive] += self.outputs[at]
            step += 1
        return out
