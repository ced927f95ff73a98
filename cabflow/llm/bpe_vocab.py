"""Byte-pair vocabularies read from a tokenizer file, cutting texts into words, merging words.

Words are bytes. The file's own normaliser and pre-tokeniser (components of
the public ``tokenizers`` library) define them; for texts of tabs, line ends
and visible Latin-1 characters, where all engines agree on the character
classes, the same pattern is applied without the library.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from cabflow.llm.pieces import Ragged, flat_bytes, strings

#: The public pattern of byte-level pre-tokenisers that bring no pattern of their own.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Another public pattern; it leaves white space out.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
_SPACE_PAIR = re.compile(r" \s|\s ")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LATIN = re.compile("[\t\n\r -~¡-ÿ]+")
#: Words of more symbols are merged one by one with a heap, others many at a time: so many bytes.
LONG_WORD, TOGETHER = 32, 1 << 18
#: Kinds of characters: letters, numbers, visible others, the space, and what only the pattern itself can judge.
_LETTER, _NUMBER, _OTHER, _SPACE, _ODD = range(5)


def _kind(char: str) -> int:
    if char == "'" or not _LATIN.fullmatch(char):
        return _ODD
    kinds = ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"[^\s]", _OTHER), (" ", _SPACE))
    return next((kind for pattern, kind in kinds if regex.fullmatch(pattern, char)), _ODD)


@functools.cache
def _latin_tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each visible Latin-1 character, and its lower form."""
    chars = [chr(c) for c in range(256)]
    return np.array([_kind(c) for c in chars], np.uint8), np.array([ord(c.lower()) for c in chars], np.uint16)


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: visible Latin-1 stands for itself, the rest follows from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Symbols, merges and special strings of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        #: By left symbol: right symbol -> rank; by rank: the symbol made.
        self.ranks: dict[int, dict[int, int]] = {}
        for (a, b), (rank, _) in self.merges.items():
            self.ranks.setdefault(a, {})[b] = rank
        self.made = [made for _, made in self.merges.values()]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self._byte = byte_alphabet()
        char = {b: c for c, b in self._byte.items()}
        self.first = [ids[char[b]] for b in range(256)]
        self.last = [ids[char[b] + end] for b in range(256)]
        self._first_of, self._last_of, self._made_of = (np.array(x, np.int32) for x in (self.first, self.last, self.made))
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.library, self._normalise, self._cut = library, library.normalizer, library.pre_tokenizer
        self._pattern, self._lower = self._plain_rule(spec)

    @staticmethod
    def _plain_rule(spec: dict) -> tuple[regex.Pattern | None, bool]:
        """Pattern and lowering that stand for the file's rules on Latin-1 texts, if they are of a known kind."""
        steps = (spec["normalizer"] or {}).get("normalizers") or ([spec["normalizer"]] if spec["normalizer"] else [])
        kinds = [s["type"] for s in steps]
        spaces = all(s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps if s["type"] == "Replace")
        if not spaces or set(kinds) - {"NFC", "Replace", "Lowercase"}:
            return None, False
        cut = spec["pre_tokenizer"]
        if cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and "Replace" not in kinds:
            return regex.compile(BYTE_LEVEL_PATTERN), "Lowercase" in kinds
        parts = cut.get("pretokenizers", [])
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            return regex.compile(parts[0]["pattern"]["Regex"]), "Lowercase" in kinds
        return None, False

    def symbols(self, word: bytes) -> list[int]:
        """Initial symbols of a word; the last carries the end-of-word mark."""
        first = self.first
        return [first[b] for b in word[:-1]] + [self.last[word[-1]]]

    def words(self, text: str) -> list[bytes | int]:
        """Pre-tokens in order; a special string is its id."""
        if self._special and self._special.search(text):
            return [w for part in self._special.split(text) if part for w in ([self.special[part]] if part in self.special else self._words(part))]
        return self._words(text)

    def cut_pieces(self, pieces: list[bytes]) -> list[list[str | bytes | int]]:
        """Pre-tokens of each piece (no white space inside); those of visible Latin-1 pieces as text, which is their bytes."""
        texts = b"\n".join(pieces).decode().split("\n") if pieces else []
        if self._pattern is None:
            return list(map(self.words, texts))
        joined = "\n".join(texts)
        odd: set[str] = set()
        if not _LATIN.fullmatch(joined) or self._special and self._special.search(joined):
            odd = {t for t in texts if not _LATIN.fullmatch(t) or self._special and self._special.search(t)}
        plain = [t for t in texts if t not in odd] if odd else texts
        joined = "\n".join(plain)
        found = map(self._pattern.findall, (joined.lower() if self._lower else joined).split("\n"))
        return [self.words(t) if t in odd else next(found) for t in texts]

    def cut_runs(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Which of the pieces (``large_string``) are plain; the pre-tokens of these, lowered if the file says so, and how many each has.

        Plain are visible Latin-1 pieces without apostrophes, special strings
        and white space but one leading space, if the file's pattern is a
        known one: their pre-tokens are runs of letters, numbers or others.
        """
        known = self._pattern is not None and self._pattern.pattern in (BYTE_LEVEL_PATTERN, WORD_PATTERN)
        raw, edges = flat_bytes(pieces)
        if not known or not len(raw):
            return np.zeros(len(pieces), bool), pieces.slice(0, 0), np.zeros(0, np.int64)
        plain = np.diff(edges) > 0
        for special in self.special:
            plain &= ~np.asarray(pc.match_substring(pieces, special))
        kinds, lower = _latin_tables()
        kind = np.where(raw < 128, kinds[raw], _ODD).astype(np.uint8)
        lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3))
        char = (raw[lead] & 3).astype(np.int64) << 6 | raw[lead + 1] & 63
        kind[lead] = kind[lead + 1] = kinds[char]
        first = np.zeros(len(raw), bool)
        first[edges[:-1][plain]] = True
        odd = kind == _ODD
        odd |= (kind == _SPACE) & ~first if self._pattern.pattern == BYTE_LEVEL_PATTERN else kind == _SPACE
        plain[np.searchsorted(edges, np.flatnonzero(odd), side="right") - 1] = False
        if self._lower:
            raw = np.where(raw < 128, lower[raw], raw).astype(np.uint8)
            raw[lead + 1] = lower[char] & 63 | 128
        begins = first.copy()
        begins[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        if self._pattern.pattern == WORD_PATTERN:
            begins |= (kind == _NUMBER) & (raw & 0xC0 != 0x80)
        inside = np.repeat(plain, np.diff(edges))
        raw, begins = raw[inside], begins[inside]
        starts = np.flatnonzero(begins)
        ends = np.cumsum(np.diff(edges)[plain])
        return plain, strings(raw, np.append(starts, len(raw))), np.diff(np.searchsorted(starts, ends), prepend=0)

    def _words(self, part: str) -> list[bytes]:
        if self._pattern is not None and _LATIN.fullmatch(part):
            return [w.encode() for w in self._pattern.findall(part.lower() if self._lower else part)]
        if self._normalise is not None:
            part = self._normalise.normalize_str(part)
        return [bytes(map(self._byte.__getitem__, w)) for w, _ in self._cut.pre_tokenize_str(part) if w]

    @functools.cached_property
    def _pair_table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open-addressing table of the merges: keys, ranks, shift."""
        bits = max(4, (4 * len(self.merges)).bit_length())
        keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        pairs = np.array([a << 32 | b for a, b in self.merges], np.int64)
        slot = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
        left = np.arange(len(pairs))
        while len(left):
            free = left[keys[slot[left]] < 0]
            keys[slot[free]] = pairs[free]
            settled = keys[slot[left]] == pairs[left]
            ranks[slot[left[settled]]] = left[settled]  # merges are listed by rank
            left = left[~settled]
            slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
        return keys, ranks, bits

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, a number above all ranks for those without a merge."""
        keys, ranks, bits = self._pair_table
        pair = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
        found = keys[slot]
        out = np.where(found == pair, ranks[slot], len(self.made))
        open_ = np.flatnonzero((found != pair) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << bits) - 1)
            found = keys[slot[open_]]
            hit = found == pair[open_]
            out[open_[hit]] = ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: every word merges its lowest-rank pair, leftmost on ties, until none is left."""
        found = self.merge_array(pa.array(words, pa.large_binary()))
        ids, ends = found.values.tolist(), (found.starts + found.sizes).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merge_array(self, words: pa.Array) -> Ragged:
        """``merge_words`` over a ``large_string`` or ``large_binary`` array."""
        raw, edges = flat_bytes(words)
        sizes = np.diff(edges)
        short = (sizes > 0) & (sizes <= LONG_WORD)
        symbol = np.full(len(raw), -1, np.int32)
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            ids = self.merge_long(raw[edges[i] : edges[i + 1]].tobytes())
            symbol[edges[i] : edges[i] + len(ids)] = ids
        todo = np.flatnonzero(short)
        todo = todo[np.argsort(sizes[todo], kind="stable")]  # words of one length end together
        ends = np.cumsum(sizes[todo])
        cuts = [*np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, TOGETHER), side="left").tolist(), len(todo)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                self._merge_together(raw, edges[todo[a:b]], sizes[todo[a:b]], symbol)
        kept = symbol >= 0
        before = np.concatenate(([0], np.cumsum(kept)))
        return Ragged(symbol[kept], np.diff(before[edges]))

    def _merge_together(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """Merge the words at ``starts`` in ``raw``; each symbol left is put where its first byte stands."""
        at = np.cumsum(size) - size
        place = np.repeat(starts - at, size)
        place += np.arange(len(place))
        ends = at + size - 1
        symbol = self._first_of[raw[place]]
        symbol[ends] = self._last_of[raw[place[ends]]]
        none = len(self.made)
        rank = np.full(len(symbol), none, np.int32)
        pairs = np.ones(len(symbol), bool)
        pairs[ends] = False
        pairs = np.flatnonzero(pairs)
        rank[pairs] = self.pair_ranks(symbol[pairs], symbol[pairs + 1])
        while len(size):
            lowest = np.minimum.reduceat(rank, at)
            go = lowest < none
            if not go.all():
                on = np.repeat(go, size)
                out[place[~on]] = symbol[~on]
                symbol, rank, place = symbol[on], rank[on], place[on]
                size, lowest = size[go], lowest[go]
                at = np.cumsum(size) - size
                if not len(size):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            if len(hit) > len(size):  # the leftmost of each word
                hit = hit[np.searchsorted(hit, at)]
            symbol[hit] = self._made_of[lowest]
            on = np.ones(len(symbol), bool)
            on[hit + 1] = False
            symbol, rank, place = symbol[on], rank[on], place[on]
            fewer = np.arange(len(size))
            size, at, hit = size - 1, at - fewer, hit - fewer
            rank[hit] = none
            k = hit[hit < at + size - 1]
            rank[k] = self.pair_ranks(symbol[k], symbol[k + 1])
            k = hit[hit > at] - 1
            rank[k] = self.pair_ranks(symbol[k], symbol[k + 1])

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one word, by a heap of pairs over a linked list."""
        ids = self.symbols(word)
        nxt = [*range(1, len(ids)), -1]
        prv = list(range(-1, len(ids) - 1))
        heap = [(self.merges[p][0], at, self.merges[p][1]) for at, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            rank, at, made = heapq.heappop(heap)
            right = nxt[at]
            if ids[at] < 0 or right < 0 or self.merges.get((ids[at], ids[right])) != (rank, made):
                continue
            ids[at], ids[right] = made, -1
            nxt[at] = nxt[right]
            if nxt[at] >= 0:
                prv[nxt[at]] = at
            for a, b in ((prv[at], at), (at, nxt[at])):
                if a >= 0 and b >= 0 and (found := self.merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, found[1]))
        return [i for i in ids if i >= 0]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo(dict):
    """``memo[key]`` computes a missing value; holds at most ``limit`` keys, then starts anew."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


def spaced_pieces(text: str) -> list[str]:
    """Pieces whose byte-level pre-tokens, in order, are those of ``text``.

    Cuts before each lone space between two characters that are not white
    space. No pre-token crosses such a place: a space before a visible
    character always opens the next pre-token.
    """
    if not text:
        return []
    if "\0" not in text and _SPACE_PAIR.search(text) is None:  # every space is a lone one
        parts = text.replace(" ", "\0 ").split("\0")
        return parts if parts[0] else parts[1:]
    parts = _LONE_SPACE.split(text)
    return [parts[0], *(" " + p for p in parts[1:])]
