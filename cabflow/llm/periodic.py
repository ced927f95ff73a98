"""Periodic runs of words by maximal pairs (operator 11).

A run is a stretch of words with smallest period ``q``, at least two periods
and ``min_words`` words long, that neither neighbouring word extends. It is
the same thing as a *maximal pair*: two places ``s`` and ``s + q`` from which
the same ``l`` words follow, where the words before and the words after
differ, and ``l >= q``; the run is ``[s, s + l + q)``. So no stretch is ever
extended word by word. Multiples of ``q`` give pairs over the same stretch;
the least distance of a stretch is its smallest period (a stretch of two
periods ``d`` whose smallest period is ``q`` has ``q`` dividing ``d``).

Per text: suffixes are ordered by prefix doubling (only those not yet unique
take part in a round), neighbours get their longest common prefix from the
ranks of the rounds, and the tree of LCP intervals is walked bottom-up. A
node holds its positions as sorted lists, one for each word to the left
(class) and one of all. Where two children meet at a common prefix of ``l``
words, each place of the smaller one looks up places of other classes within
``l`` words in the larger one, then joins it. As ``l + q >= min_words`` and
``q <= l``, common prefixes under half of ``min_words`` are never looked at,
and most texts have none longer.

One narrow pass, texts of a batch together in numpy; no shuffle and nothing
for the driver. A lost executor's task is run again.

Defined cases: a null or empty text has no words, no runs and an empty
collapsed text; texts are taken whole whatever their length; repeated rows
give a result each; a null id changes nothing; columns of the input named
like a result column (``runs``, ``collapsed``) are replaced, all others pass
through. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cabflow.llm.common import Words, mix, prepare, slices, text_bytes

#: Words that the shortest run has.
MIN_WORDS = 12
#: Bytes of text whose suffixes are ordered together.
TOGETHER = 2 << 20

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
ARROW_RUNS = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))


def suffix_levels(symbols: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols until all are unique.

    ``room`` is the number of symbols from each place to its text's end.
    Symbols of different texts must differ. Equal ranks are equal prefixes;
    the last ranks are the places in the order of the suffixes. A rank of
    one place more than there are suffixes stands for reading past the end.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    begins = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    at = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = at[group]
    levels = [rank]
    active = order[np.diff(np.concatenate((at, [n])))[group] > 1]
    step = 1
    while len(active):
        follows = np.where(room[active] > step, rank[np.minimum(active + step, n)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) * (n + 2) + follows
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        outer = np.concatenate(([True], old[1:] != old[:-1]))
        at = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        outer_at = np.flatnonzero(outer)[np.cumsum(outer) - 1]
        rank = rank.copy()
        rank[active] = old + (at[group] - outer_at)
        levels.append(rank)
        active = active[np.diff(np.concatenate((at, [len(active)])))[group] > 1]
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``a`` and ``b``, pair by pair."""
    n = len(levels[0]) - 1
    length = np.zeros(len(a), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        ranks = levels[power]
        same = ranks[np.minimum(a + length, n)] == ranks[np.minimum(b + length, n)]
        length += np.where(same, 1 << power, 0)
    return length


class _Node:
    """Places of an LCP interval: all of them, and by the word to their left; both sorted."""

    __slots__ = ("all", "of")

    def __init__(self, place: int, left: int):
        self.all = [place]
        self.of = {left: [place]}


def _met(one: _Node, other: _Node, length: int, shortest: int, found: list[tuple[int, int, int]]) -> _Node:
    """Join two children of an interval of common prefix ``length``; their maximal pairs go to ``found``."""
    if len(one.all) < len(other.all):
        one, other = other, one
    least = max(1, shortest - length)
    for left, places in other.of.items():
        if len(one.of) == 1 and left in one.of:
            continue  # the same word to the left everywhere: no pair is maximal
        for place in places:
            low = bisect_left(one.all, place - length)
            high = bisect_right(one.all, place + length, low)
            if low == high:
                continue
            if high - low <= len(one.of):
                same = one.of.get(left)
                near = one.all[low:high]
                if same:
                    here = bisect_left(same, near[0])
                    skip = set(same[here : bisect_right(same, near[-1], here)])
                    near = [p for p in near if p not in skip]
            else:
                near = []
                for word, at in one.of.items():
                    if word != left:
                        start = bisect_left(at, place - length)
                        near += at[start : bisect_right(at, place + length, start)]
            for p in near:
                apart = abs(p - place)
                if apart >= least:
                    found.append((min(p, place), apart, length))
    for left, places in other.of.items():
        mine = one.of.setdefault(left, [])
        for place in places:
            insort(mine, place)
    for place in other.all:
        insort(one.all, place)
    return one


def _pairs(places: list[int], prefixes: list[int], left: list[int], shortest: int) -> list[tuple[int, int, int]]:
    """Maximal pairs (start, distance, length) with distance <= length of suffixes in order.

    ``prefixes[i]`` is the common prefix of suffixes ``i`` and ``i + 1``.
    """
    found: list[tuple[int, int, int]] = []
    open_: list[list] = []  # intervals not yet closed: common prefix, node
    for i, place in enumerate(places):
        node = _Node(place, left[i])
        length = prefixes[i] if i < len(prefixes) else 0
        while open_ and open_[-1][0] > length:
            above, inner = open_.pop()
            node = _met(inner, node, above, shortest, found)
        if open_ and open_[-1][0] == length:
            open_[-1][1] = _met(open_[-1][1], node, length, shortest, found)
        elif length:
            open_.append([length, node])
    return found


def find_runs(texts: list[bytes], min_words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = Words(texts)
    half = max(1, min_words // 2)
    n = len(words.hash)
    if n < 2 * half:
        return out
    # Texts in which some window of `half` words occurs twice; no run is in the others.
    window = np.zeros(n - half + 1, np.uint64)
    for i in range(half):
        window = mix(window + words.hash[i : n - half + 1 + i])
    whole = words.doc[: n - half + 1] == words.doc[half - 1 :]
    window = mix(window + words.doc[: n - half + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value, at = window[whole], words.doc[: n - half + 1][whole]
    by = np.argsort(value, kind="stable")
    twice = value[by][1:] == value[by][:-1]
    texts_in = np.unique(at[by][1:][twice])
    if not len(texts_in):
        return out
    chosen = np.flatnonzero(np.isin(words.doc, texts_in))
    doc = words.doc[chosen]
    _, symbol = np.unique(words.hash[chosen], return_inverse=True)
    symbol = symbol.astype(np.int64) + doc.astype(np.int64) * (n + 1)
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    begin = np.flatnonzero(first)[np.cumsum(first) - 1]
    sizes = words.per_doc[doc]
    place = np.arange(len(chosen)) - begin
    levels = suffix_levels(symbol, sizes - place)
    order = np.argsort(levels[-1][:-1], kind="stable")
    a, b = order[:-1], order[1:]
    near = np.ones(len(a), bool)
    for power, ranks in enumerate(levels):
        if 1 << power <= half:
            near &= ranks[a] == ranks[b]
    prefix = np.zeros(len(a), np.int64)
    prefix[near] = common_prefixes(levels, a[near], b[near])
    prefix[prefix < half] = 0
    left = np.where(first, -1, np.concatenate(([-1], symbol[:-1])))
    # Stretches of the suffix order whose neighbours share `half` words or more.
    inside = prefix > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    lows, highs = edge[::2], edge[1::2]  # suffixes low .. high (inclusive)
    if not len(lows):
        return out
    member = np.repeat(np.arange(len(lows)), highs - lows + 1)
    spots = np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(lows, highs)])
    at_text = order[spots]
    starts = np.concatenate(([0], np.cumsum(highs - lows + 1)[:-1]))
    lefts = left[at_text]
    diverse = np.minimum.reduceat(lefts, starts) != np.maximum.reduceat(lefts, starts)
    sort = np.lexsort((at_text, member))
    gap = np.diff(at_text[sort], append=np.iinfo(np.int64).max)
    gap[np.concatenate((starts[1:] - 1, [len(gap) - 1]))] = np.iinfo(np.int64).max
    reach = np.maximum.reduceat(np.concatenate((prefix, [0]))[spots], starts)
    wanted = diverse & (np.minimum.reduceat(gap, starts) <= reach)
    found: dict[int, dict[tuple[int, int], int]] = {}
    for k in np.flatnonzero(wanted):
        lo, hi = lows[k], highs[k]
        places = order[lo : hi + 1]
        pairs = _pairs(places.tolist(), prefix[lo:hi].tolist(), left[places].tolist(), min_words)
        if pairs:
            runs = found.setdefault(int(doc[places[0]]), {})
            base = int(begin[places[0]])
            for start, apart, length in pairs:
                key = (start - base, length + apart)
                runs[key] = min(runs.get(key, apart), apart)
    for text, runs in found.items():
        out[text] = sorted(((s, n, q) for (s, n), q in runs.items()), key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change)[:-1] == 0
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def periodic_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the ``runs`` of the words of ``text`` and its ``collapsed`` form.

    ``runs`` are (start word, length, smallest period) by start and period;
    ``collapsed`` keeps the first period of each run. See the module
    docstring for the cases.
    """
    if min_words < 2:
        raise ValueError("a run has two words at least")
    prepare(docs.sparkSession)
    made = ["runs", "collapsed"]
    docs = docs.drop(*[c for c in made if c != text])
    schema = T.StructType(
        docs.schema.fields + [T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, TOGETHER):
                texts = text_bytes(batch.column(text))
                found = find_runs(texts, min_words)
                short = [collapse(t.split(), r).decode() for t, r in zip(texts, found)]
                rows = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(rows, ARROW_RUNS), pa.array(short, pa.string())], names=[*batch.schema.names, *made]
                )

    return docs.mapInArrow(run, schema)


def _made_periodic(doc_id: int | None, text: bytes) -> bytes:
    """The text in whose place the contract of the query puts that of one id in ten."""
    code = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    words = text.split()
    if doc_id is None or code % 10 or not words:
        return text
    g, n = code // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the texts that the query's contract makes periodic."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_made_periodic(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", "text").schema)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    longest = F.expr("array_min(transform(runs, r -> named_struct('shorter', -r.length, 'start', r.start, 'period', r.period)))")
    lines = F.expr("array_join(transform(runs, r -> format_string('%d,%d,%d\\n', r.start, r.length, r.period)), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest.alias("run"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "run.start",
        (-F.col("run.shorter")).alias("length"),
        "run.period",
        F.expr("(-1000 * run.shorter) div run.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, one id in ten made periodic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return run_digests(periodic_runs(planted(docs)))
