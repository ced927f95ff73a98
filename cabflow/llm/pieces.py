"""Texts as pieces that encode alone, and their ids, as flat arrays (operators 8 and 9).

A slice of texts is cut into pieces by its bytes; each distinct piece is
encoded once and its ids are gathered for every place where it stands. No
piece is a Python object.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Ragged:
    """Rows of ids, one behind the other."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.sizes)

    @staticmethod
    def of(rows: list[list[int]]) -> Ragged:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return Ragged(np.fromiter((i for row in rows for i in row), np.int32, int(sizes.sum())), sizes)

    def edges(self) -> pa.Array:
        """Offsets of the rows, as lists of ``pyarrow`` take them."""
        return pa.array(np.append(self.starts, len(self.values)), pa.int32())

    def take(self, index: np.ndarray) -> Ragged:
        """The rows at ``index``."""
        out = Ragged(np.zeros(0, np.int32), self.sizes[index])
        place = np.repeat(self.starts[index] - out.starts, out.sizes)
        place += np.arange(len(place))
        out.values = self.values[place]
        return out

    def joined(self, counts: np.ndarray) -> Ragged:
        """Neighbouring rows as one, ``counts`` of them each."""
        before = np.concatenate(([0], np.cumsum(self.sizes)))
        ends = np.cumsum(counts)
        return Ragged(self.values, before[ends] - before[ends - counts])

    def followed_by(self, *others: Ragged) -> Ragged:
        parts = (self, *others)
        return Ragged(np.concatenate([p.values for p in parts]), np.concatenate([p.sizes for p in parts]))


NONE = Ragged(np.zeros(0, np.int32), np.zeros(0, np.int64))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a ``large_string`` or ``large_binary`` array without nulls, and the offsets of its rows in them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


def strings(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    """``large_string`` rows that lie behind one another in ``raw``."""
    offsets = np.ascontiguousarray(edges, np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def texts_of(column: pa.Array) -> pa.Array:
    """``large_string``, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def white_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of bytes other than ASCII white space, and how many each text has (empty ones may be among them)."""
    cut = pc.ascii_split_whitespace(texts)
    return cut.flatten(), np.asarray(pc.list_value_length(cut), np.int64)


#: Bytes that begin a character which is not white space in any sense, whatever follows them.
_INK = np.zeros(256, bool)
_INK[0x21:0x7F] = _INK[0xC3:0xE0] = _INK[0xE4:0xF5] = True


def spaced_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces whose byte-level pre-tokens, in order, are those of each text, and how many each text has.

    Cuts before a space with a visible character after it or before it. No
    pre-token crosses such a place: a space before a visible character opens
    the next pre-token, white space behind a visible one is no part of its.
    A lone line end between visible characters is a piece and a pre-token.
    """
    raw, edges = flat_bytes(texts)
    if not len(raw):
        return texts.slice(0, 0), np.zeros(len(texts), np.int64)
    begins = np.zeros(len(raw) + 1, bool)
    begins[edges[:-1]] = True
    space = np.flatnonzero(raw == 32)
    last = begins[space + 1]  # of its text, but for the very last byte
    if len(space) and space[-1] == len(raw) - 1:
        last[-1] = True
    after = _INK[raw[np.minimum(space + 1, len(raw) - 1)]] & ~last
    ahead = raw[np.maximum(space - 1, 0)]
    begins[space[after | ((ahead > 0x20) & (ahead < 0x7F))]] = True
    line = np.flatnonzero(raw[1:-1] == 10) + 1
    visible = raw[line - 1]
    line = line[(visible > 0x20) & (visible < 0x7F) & _INK[raw[line + 1]] & ~begins[line] & ~begins[line + 1]]
    begins[line] = begins[line + 1] = True
    begins[-1] = False
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, edges)
    return strings(raw, np.append(starts, len(raw))), np.diff(bounds)


class Remembered:
    """Ids of pieces by ``encode``; those of about the last ``limit`` pieces are kept, those that come again longest."""

    def __init__(self, encode: Callable[[pa.Array], Ragged], limit: int):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.pieces, self.ids = pa.array([], pa.large_string()), NONE

    def of(self, pieces: pa.Array) -> Ragged:
        """Ids of each of these pieces, which may repeat."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        at = np.array(pc.fill_null(pc.index_in(distinct, value_set=self.pieces), -1), np.int64)
        new = at < 0
        unknown = distinct.filter(pa.array(new))
        at[new] = len(self.pieces) + np.arange(len(unknown))
        known = self.ids.followed_by(self.encode(unknown))
        found = known.take(at)
        if len(known) > self.limit:  # what comes again is worth keeping
            self.pieces, self.ids = distinct, found
        else:
            self.pieces, self.ids = pa.concat_arrays([self.pieces, unknown]), known
        return found.take(np.asarray(coded.indices, np.int64))
