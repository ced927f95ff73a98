"""A minimal acyclic transducer over words, stored as flat arrays and memory-mapped.

States share suffixes (minimal acyclic automaton built from sorted words).
Each arc carries a number; the numbers along a word's path add up to the
word's index, which points into the table of id sequences. Lookups walk
all words of a batch together, one byte a step.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from cabflow.llm.pieces import Ragged, flat_bytes

_MAGIC = np.int64(0x314C584C43415446)


def build(entries: dict[bytes, list[int]]) -> bytes:
    """Serialise a lexicon of word -> ids."""
    registry: dict[tuple, int] = {}
    arcs: list[tuple] = []  # by state: ((byte, target), ...)
    final: list[bool] = []

    def settle(node: list) -> int:
        key = (node[0], tuple((b, settle_target) for b, settle_target in node[1]))
        if key not in registry:
            registry[key] = len(arcs)
            arcs.append(key[1])
            final.append(node[0])
        return registry[key]

    # The path of the last word: [is_final, [(byte, state), ...]] per depth; states below are settled.
    path: list[list] = [[False, []]]
    last = b""

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))

    words = sorted(w for w in entries if w)
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        fold(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    fold(0)
    root = settle(path[0])

    paths = np.zeros(len(arcs), np.int64)  # words accepted from each state; targets settle before sources
    keys, target, add = [], [], []
    for state, out in enumerate(arcs):
        total = int(final[state])
        for byte, to in out:
            keys.append(state << 8 | byte)
            target.append(to)
            add.append(total)
            total += int(paths[to])
        paths[state] = total
    ids = [entries[w] for w in words]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int64)
    flat = np.array([i for x in ids for i in x], np.int64)
    head = np.array([_MAGIC, root, len(arcs), len(keys), len(words), len(flat)], np.int64)
    parts = [head, np.array(keys, np.int64), np.array(target, np.int64), np.array(add, np.int64), np.array(final, np.int64), offsets, flat]
    return b"".join(np.asarray(p, np.int64).tobytes() for p in parts)


class Lexicon:
    """A lexicon file, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, mode="r")
        magic, self.root, states, arcs, words, flat = (int(x) for x in data[:6])
        if magic != int(_MAGIC):
            raise ValueError(f"{path} is no lexicon file")
        at = 6
        fields = []
        for n in (arcs, arcs, arcs, states, words + 1, flat):
            fields.append(data[at : at + n])
            at += n
        self.keys, self.target, self.add, self.final, self.offsets, self.flat = fields
        self.n_words, self.n_states = words, states

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 for those not in the lexicon."""
        return self.find_array(pa.array(words, pa.large_binary()))

    def find_array(self, words: pa.Array) -> np.ndarray:
        """``find`` over a ``large_string`` or ``large_binary`` array."""
        n = len(words)
        index = np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        raw, edges = flat_bytes(words)
        start, size = edges[:-1], np.diff(edges)
        state = np.full(n, self.root, np.int64)
        live = np.flatnonzero(size)
        dead = size == 0
        step = 0
        while len(live):
            key = state[live] << 8 | raw[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            dead[live[~hit]] = True
            live, arc = live[hit], arc[hit]
            state[live] = self.target[arc]
            index[live] += self.add[arc]
            step += 1
            live = live[size[live] > step]
        index[dead | (self.final[state] == 0)] = -1
        return index

    @functools.cached_property
    def table(self) -> Ragged:
        """Ids of all words."""
        return Ragged(self.flat.astype(np.int32), np.diff(self.offsets))

    def ids(self, index: int) -> list[int]:
        return self.flat[self.offsets[index] : self.offsets[index + 1]].tolist()


@functools.lru_cache(maxsize=2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)
