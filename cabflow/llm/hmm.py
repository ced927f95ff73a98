r"""Hidden Markov language model (operator 7).

Tokens are the words ``[^\x20\x09-\x0D]+`` with A-Z lowered, then one end.
Latent states emit the end and words: every word of the training texts has
an emission of its own, and all words that training has not seen are one
more. Words seen once give half of their mass to the unseen one.

1. Texts are dealt by hash into blocks. A block numbers its distinct words by
   hash and writes each text as these numbers, with how often its training
   texts hold each word: one table, bucketed by block, so that no later step
   shuffles the texts.
2. Count the words: each block sends its counts, packed by range of word
   hashes; a range adds up what it gets per word, sends each block the sums of
   its words (one written table, packed) and writes the distinct words with
   their counts. Those give the totals and the ``OWN`` most frequent words.
   The first model, which only has to tell the states apart, takes the other
   words by hash class.
3. Baum-Welch: in each round every block runs forward-backward over its whole
   training texts under the present model. Expected counts of the frequent
   words, starts and moves (a table of fixed size) are added up for the
   driver. Those of the other words are a distributed table: each block sends
   its own, packed by range; a range adds them up and sends each block the
   sums of its words for the next round. Counts are summed as integers
   (2**-20), so their order does not matter.
4. The scaled forward recursion over each whole text gives its likelihood.

Defined cases: a null or empty text is one end token; a null document id
counts as the empty id; repeated rows are trained on and scored once per
row; with no training texts at all the model is uniform; columns named like
a result are replaced, one named ``block`` or ``symbols`` is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cabflow.llm.common import Words, cut, cut_by, most_frequent, n_blocks, parcels, prepare, release, text_bytes, with_blocks

STATES, OWN, CLASSES, ROUNDS = 6, 16_384, 2_048, 6
#: Symbols of the first model: end, rare, the frequent words, the classes. In a block, its words stand for themselves from FIRST_WORD on.
END, RARE, FIRST_OWN, FIRST_CLASS = 0, 1, 2, 2 + OWN
SYMBOLS = FIRST_CLASS + CLASSES
FIRST_WORD = 1
BLOCK_BYTES, SLICE_BYTES, RANGE_BYTES = 24 << 20, 2 << 20, 16 << 20
#: Tokens whose forward probabilities are held at a time, and weight of a word's overall frequency in its emissions.
CELLS, PRIOR = 1 << 19, 10.0
#: Steps between two scalings, and cells that are summed up at a time.
SCALED, PIECE = 8, 1 << 13
UNIT = 1 << 20
RESULTS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# ------------------------------------------------------------------ words


def _words(texts: list[bytes]) -> Iterator[tuple[slice, Words]]:
    for rows in parcels([len(t) for t in texts], SLICE_BYTES):
        yield rows, Words(texts[rows], lower=True)


def _texts(table: pa.Table) -> list[bytes]:
    return [t for chunk in table.column("_text").chunks for t in text_bytes(chunk)]


def to_symbols(schema: pa.Schema):
    """Texts of a block -> their symbols; the block's words, and how often its training texts hold them, on its first row."""

    def run(table: pa.Table) -> pa.Table:
        texts = _texts(table)
        found = [(w.hash.view(np.int64), w.per_doc) for _, w in _words(texts)]
        word, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
        sizes = np.concatenate([n for _, n in found])
        trained = np.repeat(~np.asarray(table.column("held_out").combine_chunks()), sizes)
        seen = np.bincount(at[trained], minlength=len(word))
        at = (at + FIRST_WORD).astype(np.uint32)
        edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
        end = np.full(1, END, np.uint32)
        rest = [None] * (table.num_rows - 1)
        out = {
            "symbols": [planes(np.concatenate((at[x:y], end))) for x, y in zip(edges[:-1], edges[1:])],
            "n_tokens": sizes + 1,
            "_words": [packed_words(word), *rest],
            "_seen": [packed(seen[:, None]), *rest],
        }
        kept = table.drop_columns(["_text"])
        return pa.table([*kept.columns, *(pa.array(out[c], schema.field(c).type) for c in out)], schema=schema)

    return run


def _bounds(ranges: int) -> np.ndarray:
    """The first words of all ranges of word hashes but the lowest."""
    return np.array([-(1 << 63) + (k << 64) // ranges for k in range(1, ranges)], np.int64)


def _cuts(words: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the sorted ``words``, without empty ones."""
    edges = [0, *np.searchsorted(words, _bounds(ranges)).tolist(), len(words)]
    return [(r, a, b) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def sent_counts(ranges: int):
    """Each block's words and training counts, cut by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, seen in zip(*(batch.column(c).to_pylist() for c in ("block", "_words", "_seen"))):
                words, seen = unpacked_words(words), unpacked(seen, 1)
                cuts = _cuts(words, ranges)
                columns = [[block] * len(cuts), [r for r, *_ in cuts], [packed_words(words[a:b]) for _, a, b in cuts], [packed(seen[a:b]) for _, a, b in cuts]]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "range", "words", "units"])

    return run


def add_counts(table: pa.Table) -> pa.Table:
    """What the blocks sent to one range -> for each of them the sums of its words, and the training words with their counts."""
    word, sums, back = _added(table, 1)
    n = sums[:, 0]
    back = pa.table([table.column("block"), table.column("range"), pa.array(back, pa.binary())], names=["block", "range", "seen"])
    words = pa.table([pa.array(word[n > 0], pa.int64()), pa.array(n[n > 0], pa.int64())], names=["word", "n"])
    return pa.concat_tables([back, words], promote_options="default")


class Counts:
    """What all tasks need of the training counts: totals and the first model's symbol table, of fixed size."""

    def __init__(self, tokens: int, distinct: int, texts: int, once: int, own: list[tuple[int, int]], classes: dict[int, int]):
        self.tokens, self.distinct, self.texts, self.once = tokens, distinct, texts, once
        word, n = (np.array(x, np.int64) for x in (zip(*own) if own else ((), ())))
        order = np.argsort(word)
        self.own, self.own_symbol = word[order], order + FIRST_OWN
        self.class_total = np.zeros(CLASSES)
        for c, total in classes.items():
            self.class_total[c] = total
        np.subtract.at(self.class_total, word % CLASSES, n)
        #: Training count of each symbol.
        self.symbol_total = np.zeros(SYMBOLS)
        self.symbol_total[END], self.symbol_total[RARE] = texts, once
        self.symbol_total[FIRST_OWN : FIRST_OWN + len(n)] = n
        self.symbol_total[FIRST_CLASS:] = self.class_total

    def symbols(self, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word seen ``n`` times, and log10 of the word's share of its symbol."""
        symbol = np.where(n > 1, FIRST_CLASS + word % CLASSES, RARE)
        share = np.zeros(len(word))
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, word), len(self.own) - 1)
            own = (self.own[at] == word) & (n > 1)
            symbol[own] = self.own_symbol[at[own]]
        else:
            own = np.zeros(len(word), bool)
        seen = (n > 1) & ~own
        share[seen] = np.log10(n[seen] / self.class_total[word[seen] % CLASSES])
        share[n == 1] = np.log10(0.5 / max(1, self.once))
        share[n == 0] = np.log10(0.5 if self.once else 1.0)
        return symbol, share

    def prior(self, n: np.ndarray | float) -> np.ndarray | float:
        """Overall frequency of a word seen ``n`` times; the training words, the end and the unseen word add up to one."""
        return (n + 0.1) / (self.tokens + 0.1 * (max(1, self.distinct) + 1))


def training_counts(counts: DataFrame, texts: int) -> Counts:
    """Totals, the most frequent words and the class totals; nothing here grows with the corpus."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    own = most_frequent(counts.where("n > 1"), OWN, "word")
    classes = counts.where("n > 1").groupBy(F.pmod("word", F.lit(CLASSES)).alias("c")).agg(F.sum("n").alias("n")).collect()
    tokens = int(total["n"] or 0) + texts
    return Counts(tokens, int(total["v"]) + (texts > 0), texts, int(total["once"] or 0), [(r["word"], r["n"]) for r in own], {r["c"]: r["n"] for r in classes})


# ------------------------------------------------------------------ model


class Model:
    """Start, transition (row: from) and emission (row: symbol) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @functools.cached_property
    def relative(self) -> np.ndarray:
        """Emissions by their sums over the states: shares of states need no more, and these never get small."""
        total = self.emit.sum(axis=1, keepdims=True)
        return self.emit / np.where(total > 0, total, 1.0)

    @functools.cached_property
    def cells(self) -> np.ndarray:
        """Room for four numbers of each state for each cell of a segment; one for all segments, as fresh memory costs more than filling it."""
        return np.empty((4, CELLS, len(self.start)))

    @staticmethod
    def first(total: np.ndarray, states: int, seed: int = 0) -> Model:
        noise = np.random.default_rng(seed).gamma(1.0, size=(SYMBOLS, states))
        emit = (total + 0.1)[:, None] * (0.2 + noise)
        move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Emissions:
    """Emission of every training word: the frequent ones here, the others from their expected counts."""

    def __init__(self, known: Counts, model: Model, norm: np.ndarray | None):
        self.known, self.model, self.norm = known, model, norm  # norm: expected tokens of each state, None before the first round

    @staticmethod
    def first(known: Counts, states: int) -> Emissions:
        return Emissions(known, Model.first(known.symbol_total, states), None)

    @staticmethod
    def estimated(known: Counts, start: np.ndarray, move: np.ndarray, head: np.ndarray, others: np.ndarray, once: np.ndarray) -> Emissions:
        """From expected counts (of ``head`` by symbol, of all other words and of those seen once by state)."""
        norm = head.sum(axis=0) + others + PRIOR
        total = known.symbol_total[:FIRST_CLASS]
        emit = np.where((total > 0)[:, None], head + PRIOR * known.prior(total)[:, None], 0.0)
        emit[END] = head[END] + PRIOR * known.prior(known.texts)
        emit[RARE] = 0.5 * (once + PRIOR * known.once * known.prior(1)) + PRIOR * known.prior(0)
        move, start = move + 0.1, start + 0.1
        return Emissions(known, Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / norm), norm)

    def of_block(self, block: Block) -> Model:
        """The model with the rows of a block's words; its other words have the block's expected counts."""
        head = self.model.emit
        if self.norm is None:
            symbol, share = self.known.symbols(block.words, block.seen)
            rows = head[symbol] * 10 ** share[:, None]
        else:
            seen = block.seen[block.other]
            others = block.expected
            others += PRIOR * self.known.prior(seen)[:, None]
            others /= self.norm
            others[seen == 1] *= 0.5
            rows = np.empty((len(block.words), len(self.norm)))
            rows[block.seen == 0] = head[RARE]
            rows[block.own] = head[block.symbol]
            rows[block.other] = others
        return Model(self.model.start, self.model.move, np.concatenate((head[END : END + FIRST_WORD], rows)))


class Block:
    """The words of a block: training counts, which are frequent (with their symbols) or others, and the others' expected counts."""

    def __init__(self, known: Counts, table: pa.Table, received: pa.Table | None, states: int):
        self.words = unpacked_words(next(x for x in table.column("_words").to_pylist() if x is not None))
        rows = received.sort_by("range").to_pylist() if received is not None else []  # words are sorted as ranges are
        seen = [unpacked(r["seen"], 1)[:, 0] for r in rows if r["seen"] is not None]
        self.seen = np.concatenate(seen) if seen else np.zeros(len(self.words), np.int64)
        at = np.searchsorted(self.words, known.own)
        found = at < len(self.words)
        found[found] = self.words[at[found]] == known.own[found]
        self.own, self.symbol = at[found], known.own_symbol[found]
        other = self.seen > 0
        other[self.own] = False
        self.other = np.flatnonzero(other)
        units = [unpacked(r["units"], states) for r in rows if r["units"] is not None]
        self.expected = np.divide(np.concatenate(units), UNIT, dtype=np.float32, casting="unsafe").astype(float) if units else np.zeros((len(self.other), states))


def steps_of(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Sequences by falling size: their order and starts, how many are longer than t, and the first cell of each step t."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    return order, starts[order], alive.tolist(), [0, *np.cumsum(alive).tolist()]


def cells_of(symbols: np.ndarray, starts: np.ndarray, alive: list[int], edges: list[int], first: int, end: int) -> np.ndarray:
    """Symbols of the steps ``first`` to ``end``, step by step."""
    k = np.array(alive[first:end])
    # Where a step's symbols would stand if its first cell were cell 0.
    lane = np.arange(edges[end] - edges[first], dtype=np.int32)
    lane -= np.repeat((np.array(edges[first:end]) - edges[first]).astype(np.int32), k)
    at = starts.astype(np.int32)[lane]
    at += np.repeat(np.arange(first, end, dtype=np.int32), k)
    return symbols[at]


def forward_backward(model: Model, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: list[np.ndarray]) -> None:
    """Add the expected (start, move, emit) counts of whole sequences.

    Time is cut into segments of about ``CELLS`` tokens; of all but the last
    only the entry is kept, and they run forward again on the way back.
    Probabilities are scaled every ``SCALED`` steps: a cell (one token, row:
    state) counts by its share of alpha * beta, whatever their scales.
    """
    order, starts, alive, at = steps_of(starts, sizes)
    n, length, states = len(sizes), len(alive), len(model.start)
    edges, held = [0], 0
    for t, k in enumerate(alive):
        if held and held + k > CELLS:
            edges.append(t)
            held = 0
        held += k
    edges.append(length)
    most = max(at[b] - at[a] for a, b in zip(edges[:-1], edges[1:]))
    alphas, betas, emitted, weights = model.cells if most <= model.cells.shape[1] else np.empty((4, most, states))
    weights = weights.reshape(states, -1)
    work, ones = np.empty((n, states)), np.ones((states, states))
    dot, multiply, move, back = np.dot, np.multiply, np.ascontiguousarray(model.move), np.ascontiguousarray(model.move.T)

    def forward(first: int, end: int, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Fill ``alphas`` and ``emitted`` (by the scales of alphas) with a segment; its symbols and last step."""
        place = cells_of(symbols, starts, alive, at, first, end)
        np.take(model.relative, place, axis=0, out=emitted[: len(place)], mode="clip")
        x = 0
        for t in range(first, end):
            k = alive[t]
            y = x + k
            e, before = emitted[x:y], a
            a = alphas[x:y]
            if t:
                dot(before[:k], move, a)
                multiply(a, e, a)
            else:
                multiply(model.start, e, a)
            if t % SCALED == 0:
                scale = np.dot(a, ones, out=work[:k])
                a /= scale
                e /= scale
            x = y
        return place, a

    entries: list[np.ndarray | None] = [None]
    for first, end in zip(edges[:-1], edges[1:]):
        place, a = forward(first, end, entries[-1])
        entries.append(a if end == length else a.copy())
    later = None  # emission * beta of the step after a segment
    for s in range(len(edges) - 2, -1, -1):
        first, end = edges[s], edges[s + 1]
        if s < len(edges) - 2:
            place, _ = forward(first, end, entries[s])
        y = len(place)
        betas[:y] = 1.0
        for t in range(end - 1, first - 1, -1):
            x = y - alive[t]
            b = betas[x:y]
            if later is not None:
                dot(later, back, b[: len(later)])
                if t % SCALED == 0:
                    b /= dot(b, ones, work[: len(b)])
            later = emitted[x:y]
            multiply(later, b, later)
            y = x
        later = later.copy()
        # From here on ``emitted`` holds emission * beta of each cell. The cell before (t, lane) is (t - 1, lane).
        before = np.arange(len(place)) - np.repeat([0, *alive[first : end - 1]], alive[first:end])
        m = alive[first]
        moves = np.zeros((states, states))
        for x in range(0, len(place), PIECE):
            piece = slice(x, min(x + PIECE, len(place)))
            shares = alphas[piece] * betas[piece]
            total = shares @ ones
            np.reciprocal(total, out=total)
            np.multiply(shares.T, total.T, out=weights[:, piece])
            ahead = np.multiply(emitted[piece], total, out=total)
            if x < m:
                k = min(m - x, len(ahead))
                if s:
                    moves += entries[s][x : x + k].T @ ahead[:k]
                ahead[:k] = 0.0
            moves += alphas.take(before[piece], axis=0).T @ ahead
        counts[1] += moves * model.move
        if s == 0:
            counts[0] += weights[:, :n].sum(axis=1)
        for z in range(states):
            counts[2][:, z] += np.bincount(place, weights=weights[z, : len(place)], minlength=len(model.emit))


def log_likelihood(model: Model, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each whole sequence, by the scaled forward recursion."""
    out = np.zeros(len(sizes))
    if not len(sizes):
        return out
    order, starts, alive, at = steps_of(starts, sizes)
    total, ones = np.zeros(len(sizes)), np.ones(len(model.start))
    a, first, x = None, 0, 0
    emitted = np.empty((0, len(ones)))
    for t, k in enumerate([*alive, 0]):
        if t and k < len(a):  # these end
            total[k : len(a)] += np.log10(a[k:] @ ones)
        if not k:
            break
        if x == len(emitted):
            end = max(t + 1, int(np.searchsorted(at, at[t] + PIECE, side="right")) - 1)
            emitted, x = model.emit.take(cells_of(symbols, starts, alive, at, t, end), axis=0), 0
        e = emitted[x : x + k]
        x += k
        a = model.start * e if t == 0 else np.dot(a[:k], model.move)
        if t:
            a *= e
        if t % SCALED == 0:
            scale = a @ ones
            total[:k] += np.log10(scale)
            a /= scale[:, None]
    out[order] = total
    return out


def planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers byte by byte, all lowest ones first: the upper bytes are mostly zero and compress well."""
    return np.ascontiguousarray(values, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_words(words: np.ndarray) -> bytes:
    """Sorted word hashes as differences."""
    words = words.view(np.uint64)
    return planes(words - np.concatenate((np.zeros(1, np.uint64), words[:-1]))[: len(words)], "<u8")


def unpacked_words(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64).view(np.int64)


def _flat(column: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [np.frombuffer(x, np.uint8).reshape(4, -1).T for x in column]
    symbols = np.ascontiguousarray(np.concatenate(found)).view("<u4").ravel().astype(np.int64) if found else np.zeros(0, np.int64)
    sizes = np.fromiter((len(x) // 4 for x in column), np.int64, len(column))
    return symbols, np.cumsum(sizes) - sizes, sizes


def packed(units: np.ndarray) -> bytes:
    """Counts in units (row: word), state by state, as 32-bit integers where they fit; the first byte is their width."""
    kind = "<i4" if units.max(initial=0) < 1 << 31 else "<i8"
    return bytes([np.dtype(kind).itemsize]) + planes(units.T.ravel(), kind)


def unpacked(data: bytes, states: int) -> np.ndarray:
    return from_planes(data[1:], f"<i{data[0]}").reshape(states, -1).T.astype(np.int64)


def _counts_schema(states: int) -> str:
    return "block int, range int, words binary, units binary, key int, " + ", ".join(f"s{z} long" for z in range(states))


def expected_counts(shared, states: int, ranges: int, schema: pa.Schema):
    """A block's training texts -> rows by ``key`` for the driver, and rows by ``range`` with the other words."""

    def run(table: pa.Table, messages: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        block = Block(shared.value.known, table, messages, states)
        model = shared.value.of_block(block)
        counts = [np.zeros(states), np.zeros((states, states)), np.zeros((states, len(model.emit))).T]
        texts = sorted((x for x in table.column("symbols").to_pylist() if x is not None), key=lambda x: (-len(x), x))
        # By 4 bytes a token: but for a text longer than that, none runs forward twice.
        for some in parcels([len(x) for x in texts], 4 * CELLS):
            forward_backward(model, *_flat(texts[some]), counts)
        counts[2] *= UNIT
        units = np.rint(counts[2], out=counts[2]).astype(np.int64)
        end, units = units[:FIRST_WORD], units[FIRST_WORD:]
        others = units.T.take(block.other, axis=1).T
        words, once = block.words[block.other], block.seen[block.other] == 1
        # Rows by key: the end and the frequent words by symbol, then starts, other words, words seen once, and each state's moves.
        sums = np.rint(np.vstack((counts[0][None], counts[1])) * UNIT).astype(np.int64)
        rows = np.vstack((end, units[block.own], sums[:1], others.sum(axis=0)[None], others[once].sum(axis=0)[None], sums[1:]))
        keys = np.concatenate(([END], block.symbol, [-1, -2, -3], -4 - np.arange(states)))
        used = rows.any(axis=1)
        cuts = _cuts(words, ranges)
        found = {
            "block": pa.array([table.column("block")[0].as_py()] * len(cuts), pa.int32()),
            "range": pa.array([r for r, *_ in cuts], pa.int32()),
            "words": pa.array([packed_words(words[a:b]) for _, a, b in cuts], pa.binary()),
            "units": pa.array([packed(others[a:b]) for _, a, b in cuts], pa.binary()),
        }
        by_key = {"key": pa.array(keys[used], pa.int32()), **{f"s{z}": pa.array(rows[used, z], pa.int64()) for z in range(states)}}
        return pa.concat_tables([schema.empty_table(), pa.table(found), pa.table(by_key)], promote_options="default")

    return run


def _added(table: pa.Table, states: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """What the blocks sent to one range: its words, their sums, and the sums as each block needs them."""
    words = [unpacked_words(x) for x in table.column("words").to_pylist()]
    units = np.concatenate([unpacked(x, states) for x in table.column("units").to_pylist()])
    word = np.concatenate(words)
    order = np.argsort(word)
    word = word[order]
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    sums = np.add.reduceat(units[order], first, axis=0)
    units[order] = np.repeat(sums, np.diff(np.append(first, len(word))), axis=0)
    ends = np.cumsum([len(w) for w in words])
    return word[first], sums, [packed(units[e - len(w) : e]) for w, e in zip(words, ends)]


def add_range(table: pa.Table) -> pa.Table:
    """What the blocks sent to one range -> for each of them the sums of its words."""
    _, _, sent = _added(table, table.column("states")[0].as_py())
    return pa.table([table.column("block"), table.column("range"), pa.array(sent, pa.binary())], names=["block", "range", "units"])


def messages_of(expected: DataFrame, states: int) -> DataFrame:
    """(block, range, units): the sums of each block's words."""
    sent = expected.where("range is not null").select("block", "range", "words", "units", F.lit(states).alias("states"))
    return sent.groupBy("range").applyInArrow(add_range, "block int, range int, units binary")


def to_blocks(seen: DataFrame, messages: DataFrame | None):
    """What the blocks get, by block: their words' training counts, and the expected ones after the first round."""
    sent = seen.withColumn("units", F.lit(None).cast("binary"))
    return (sent if messages is None else sent.unionByName(messages.withColumn("seen", F.lit(None).cast("binary")))).groupBy("block")


def train(coded: DataFrame, seen: DataFrame, known: Counts, states: int, rounds: int, ranges: int) -> tuple[Emissions, DataFrame | None]:
    """Baum-Welch over the training rows of ``coded``: the model, and the table of the sums that each block needs of its other words' expected counts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = coded.sparkSession
    model, messages = Emissions.first(known, states), None
    columns = [f"s{z}" for z in range(states)]
    schema = _counts_schema(states)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    texts = coded.select("block", F.when(~F.col("held_out"), F.col("symbols")).alias("symbols"), "_words")
    texts = texts.where("symbols is not null or _words is not null")
    for _ in range(rounds):
        # Of fixed size: FIRST_CLASS rows of ``states`` numbers (SYMBOLS rows in the first round).
        shared = spark.sparkContext.broadcast(model)
        run = expected_counts(shared, states, ranges, arrow)
        found = texts.groupBy("block").cogroup(to_blocks(seen, messages)).applyInArrow(run, schema)
        expected = cut(found, "expected-counts")
        if messages is not None:
            release(messages)
        added = {r[0]: np.array(r[1:], float) / UNIT for r in expected.where("key is not null").groupBy("key").agg(*(F.sum(c).alias(c) for c in columns)).collect()}
        zero = np.zeros(states)
        head = np.array([added.get(k, zero) for k in range(FIRST_CLASS)])
        move = np.array([added.get(-4 - z, zero) for z in range(states)])
        model = Emissions.estimated(known, added.get(-1, zero), move, head, added.get(-2, zero), added.get(-3, zero))
        shared.unpersist()
        # Written, so that the next round finds neither these counts nor their shuffle on the disks.
        messages = cut(messages_of(expected, states), "messages")
        release(expected)
    return model, messages


def hmm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", states: int = STATES, rounds: int = ROUNDS, folds: int = 10) -> DataFrame:
    """The columns of ``docs`` but ``text``, with fold, counts, ``base_score`` and the model's ``score``.

    Rows whose crc32 of the id as text is divisible by ``folds`` are held
    out; the model learns from all others.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*[c for c in (*RESULTS, "block", "_text", "symbols", "_words", "_seen") if c not in (text, doc_id)])
    others = [c for c in docs.columns if c != text]
    held_out = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0
    docs = docs.withColumn("held_out", held_out).withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))

    blocks = n_blocks(docs, "_text", BLOCK_BYTES)
    dealt = with_blocks(docs, doc_id, "_text", blocks).select(*others, "held_out", "block", "_text")
    kept = T.StructType([docs.schema[c] for c in [*others, "held_out"]])
    made = [T.StructField("symbols", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("_words", T.BinaryType()), T.StructField("_seen", T.BinaryType())]
    schema = T.StructType([*kept.fields, T.StructField("block", T.IntegerType()), *made])
    coded = cut_by(dealt.groupBy("block").applyInArrow(to_symbols(to_arrow_schema(schema)), schema), "symbols", "block", blocks)

    own = coded.where("_words is not null").select("block", "_words", "_seen")
    held = own.agg(F.sum(F.octet_length("_words").cast("long"))).first()[0] or 0
    ranges = max(1, -(-held * (states + 1) // RANGE_BYTES))
    sent = own.mapInArrow(sent_counts(ranges), "block int, range int, words binary, units binary")
    counted = cut(sent.groupBy("range").applyInArrow(add_counts, "block int, range int, seen binary, word long, n long"), "word-counts")
    known = training_counts(counted.where("word is not null").select("word", "n"), coded.where("not held_out").count())
    seen = counted.where("block is not null").select("block", "range", "seen")

    model, messages = train(coded, seen, known, states, rounds, ranges)
    shared = spark.sparkContext.broadcast(model)
    fields = [*kept.fields, *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))]
    scored_schema = to_arrow_schema(T.StructType(fields))

    def score(table: pa.Table, received: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return scored_schema.empty_table()
        known = shared.value.known
        block = Block(known, table, received, states)
        symbols, starts, sizes = _flat(table.column("symbols").to_pylist())
        out = {c: table.column(c) for c in (*kept.names, "n_tokens")}
        n = np.concatenate(([known.texts], block.seen))
        base = np.log10(0.1 / (known.tokens + 0.1 * (known.distinct + 1))) + np.log10((n + 0.1) / 0.1)
        text = np.repeat(np.arange(len(sizes)), sizes)
        known_words, out["base_score"] = (np.bincount(text, weights=v[symbols]) for v in ((n > 0).astype(float), base))
        out["n_known"] = known_words.astype(np.int64)
        out["score"] = log_likelihood(shared.value.of_block(block), symbols, starts, sizes)
        return pa.table([out[f.name] if isinstance(out[f.name], pa.ChunkedArray) else pa.array(out[f.name], f.type) for f in scored_schema], schema=scored_schema)

    scored = coded.drop("_seen").groupBy("block").cogroup(to_blocks(seen, messages)).applyInArrow(score, T.StructType(fields))
    scored = scored.withColumn("train_tokens", F.lit(known.tokens).cast("long"))
    return scored.select(*others, *RESULTS)


def op7_hmm_scores(spark, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return hmm_scores(docs)
