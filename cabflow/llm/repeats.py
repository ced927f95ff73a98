"""Dedup of repeated byte windows by minimizer hashing (operator 6).

The windows of ``depth`` bytes of all texts (as bytes) are grouped in three
passes, from coarse keys to the windows themselves; what shares no key with
another document leaves, and the groups left after the last pass are exactly
the windows that repeat across documents (apart from collisions of 64-bit
hashes: bytes are not compared). A byte is removed if such a window covers it
and also starts in a document with a smaller id. No suffix is sorted by its
leading bytes, as a radix sort would.

Keys are 64-bit hashes of strings of bytes:

1. the ``KMER`` bytes at a window's anchor. The anchor is the place of the
   smallest hash of all ``KMER``-byte strings in the window: equal windows
   have equal anchors, and neighbouring windows share one, so a pass moves
   one key for about fourteen windows.
2. the whole stretch of the windows that share the anchor. Inside copies
   such stretches are equal, and one key settles them all.
3. the window itself, for stretches that meet others only in part (the ends
   of copies). The block of a stretch's smallest id sends its bytes, the
   others its key; the task that compares them sorts their windows.

Texts are dealt by hash into blocks of about ``block_bytes``. A pass sends,
for each block, its distinct keys (a passage that a third of all documents
share is one key a block) packed by key range; a task compares the blocks'
keys of one range and answers each block with the keys that go on. Ranges
and blocks grow in number with the input, not in size. Each pass is written
to the shared folder, so a lost executor costs its tasks only.

Defined cases: null and empty texts have no bytes; a text shorter than
``depth`` keeps all; equal ids are not smaller than each other, so repeated
rows with one id do not remove each other; a null id counts as larger than
all ids; columns named like a result are replaced, one named
``block`` is left out. Cuts go by bytes and may
split a character, so the kept bytes are binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cabflow.llm.common import (
    BYTE_VALUES,
    cut,
    inverse_powers,
    mix,
    n_blocks,
    parcels,
    prefix_hash,
    prepare,
    release,
    spans_hash,
    text_bytes,
    with_blocks,
)

DEPTH, KMER = 50, 24
BLOCK_BYTES, RANGE_BYTES, SLICE_BYTES = 8 << 20, 8 << 20, 1 << 20
RESULTS = ("n_bytes", "spans", "kept")
_LAST = (1 << 63) - 1


class Windows:
    """The windows of a list of texts by anchor: stretch ``i`` holds the windows starting at ``low[i] .. high[i]``."""

    def __init__(self, texts: list[bytes], depth: int, kmer: int):
        self.depth = depth
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        empty = np.zeros(0, np.int64)
        self.low = self.high = self.doc = self.anchor = empty
        self.key = np.zeros(0, np.uint64)
        if n < depth:
            return
        self.prefix = prefix_hash(BYTE_VALUES[raw])
        self.inverse = inverse_powers(n)
        strings = mix((self.prefix[kmer:] - self.prefix[: n + 1 - kmer]) * self.inverse[: n + 1 - kmer])
        # Smallest (hash, place) of each window, by doubling.
        least = (strings & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(strings), dtype=np.uint64)
        span, width = depth - kmer + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = np.arange(len(anchor))
        doc = np.searchsorted(self.end, place, side="right")
        inside = place + depth <= self.end[doc]
        first = inside.copy()
        first[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        self.low = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= first[1:] | ~inside[1:]
        self.high = np.flatnonzero(last)
        self.doc = doc[self.low]
        self.anchor = anchor[self.low]
        # Hashed again: the smallest hashes of windows lie close together, key ranges must not.
        self.key = mix(strings[self.anchor])

    def stretch_keys(self, which: np.ndarray) -> np.ndarray:
        return spans_hash(self.prefix, self.inverse, self.low[which], self.high[which] + self.depth)


def windows_of(table: pa.Table, depth: int, kmer: int) -> Iterator[tuple[slice, np.ndarray, list[bytes], Windows]]:
    """A block's texts in parcels: (rows, ids, texts, windows)."""
    texts = [t for chunk in table.column("_bytes").chunks for t in text_bytes(chunk)]
    ids = np.asarray(table.column("_id").combine_chunks(), np.int64)
    for rows in parcels([len(t) for t in texts], SLICE_BYTES):
        yield rows, ids[rows], texts[rows], Windows(texts[rows], depth, kmer)


def _found(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the sorted ``known``, and whether it is there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _packed(block: int, ranges: int, key: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row per key range; the rows' columns are packed, sorted by ``key``."""
    part = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(part, np.arange(ranges + 1))
    used = np.flatnonzero(np.diff(ends))
    out = {"part": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), block), pa.int32())}
    out |= {name: pa.array([v[ends[r] : ends[r + 1]].tobytes() for r in used], pa.binary()) for name, v in columns.items()}
    return pa.table(out)


def _answers(blocks: np.ndarray, keep: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row per block with the kept entries of each column, packed."""
    at = np.flatnonzero(keep)
    at = at[np.argsort(blocks[at], kind="stable")]
    used, starts = np.unique(blocks[at], return_index=True)
    ends = np.append(starts[1:], len(at))
    out = {"block": pa.array(used, pa.int32())}
    out |= {name: pa.array([v[at[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary()) for name, v in columns.items()}
    return pa.table(out)


def _by_block(table: pa.Table, name: str, width: int) -> np.ndarray:
    """The block of each entry of a packed column."""
    sizes = np.fromiter((len(x) // width for x in table.column(name).to_pylist()), np.int64, table.num_rows)
    return np.repeat(np.asarray(table.column("block").combine_chunks()), sizes)


def _block(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def _anchors(ranges: int, depth: int, kmer: int):
    def run(table: pa.Table) -> pa.Table:
        """Digit 1: the block's distinct anchor keys, and whether two of its documents share them."""
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, ids, _, w in windows_of(table, depth, kmer):
            keys.append(w.key)
            docs.append(ids[w.doc])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(key)) - 1
        shared = (doc[first] != doc[last]).astype(np.uint8)
        return _packed(_block(table), ranges, key[first], {"keys": key[first], "shared": shared})

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Keys that two documents share, to each block that has them."""
    key, shared, block = _column(table, "keys", np.uint64), _column(table, "shared", np.uint8), _by_block(table, "keys", 8)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    count = np.diff(np.append(first, len(key)))
    any_shared = np.maximum.reduceat(shared[order], first)
    keep = np.empty(len(key), bool)
    keep[order] = np.repeat((count > 1) | (any_shared > 0), count)
    return _answers(block, keep, {"keys": key})


def _stretches(ranges: int, depth: int, kmer: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Digit 2: distinct (anchor key, stretch key) of the block with the smallest id."""
        if not table.num_rows or not answers.num_rows:
            return _packed(0, ranges, np.zeros(0, np.uint64), {n: np.zeros(0) for n in ("keys", "stretches", "lows")})
        known = np.sort(_column(answers, "keys", np.uint64))
        keys, stretches, lows = [], [], []
        for _, ids, _, w in windows_of(table, depth, kmer):
            which = np.flatnonzero(_found(w.key, known)[1])
            if len(which):
                keys.append(w.key[which])
                stretches.append(w.stretch_keys(which))
                lows.append(ids[w.doc[which]])
        if not keys:
            return _packed(0, ranges, np.zeros(0, np.uint64), {n: np.zeros(0) for n in ("keys", "stretches", "lows")})
        key, stretch, low = np.concatenate(keys), np.concatenate(stretches), np.concatenate(lows)
        order = np.lexsort((low, stretch, key))
        key, stretch, low = key[order], stretch[order], low[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])))
        return _packed(_block(table), ranges, key[first], {"keys": key[first], "stretches": stretch[first], "lows": low[first]})

    return run


def _settled_stretches(table: pa.Table) -> pa.Table:
    """Smallest id of each stretch; ``mixed`` where its anchor key has other stretches too."""
    key, stretch = _column(table, "keys", np.uint64), _column(table, "stretches", np.uint64)
    low, block = _column(table, "lows", np.int64), _by_block(table, "keys", 8)
    order = np.lexsort((low, stretch, key))
    k, s = key[order], stretch[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    per_key = np.bincount(np.cumsum(new_key) - 1, weights=new)
    least, mixed = np.empty(len(key), np.int64), np.empty(len(key), np.uint8)
    least[order] = low[order][np.flatnonzero(new)[group]]
    mixed[order] = per_key[np.cumsum(new_key) - 1] > 1
    return _answers(block, np.ones(len(key), bool), {"keys": stretch, "lows": least, "mixed": mixed})


def _mixed_stretches(ranges: int, depth: int, kmer: int):
    names = ("stretches", "counts", "lows", "contexts")

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Digit 3: the block's mixed stretches; with their bytes from the block of the smallest id."""
        none = pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in names}})
        if not table.num_rows or not answers.num_rows:
            return none
        known, lows, mixed = _known_stretches(answers)
        known, lows = known[mixed], lows[mixed]
        seen: dict[int, tuple[int, int, bytes]] = {}  # stretch -> windows if it is sent whole, anchor key, bytes
        for _, ids, texts, w in windows_of(table, depth, kmer):
            if not len(w.low):
                continue
            keys = w.stretch_keys(np.arange(len(w.low)))
            at, found = _found(keys, known)
            which = np.flatnonzero(found)
            own = ids[w.doc[which]] == lows[at[which]]
            buffer = b"".join(texts)
            for i, key, anchor, whole in zip(which.tolist(), keys[which].tolist(), w.key[which].tolist(), own.tolist()):
                if whole:
                    if not seen.get(key, (0,))[0]:
                        low, high = int(w.low[i]), int(w.high[i])
                        seen[key] = (high - low + 1, anchor, buffer[low : high + depth])
                elif key not in seen:
                    seen[key] = (0, anchor, b"")
        if not seen:
            return none
        stretch = np.fromiter(seen.keys(), np.uint64, len(seen))
        entries = list(seen.values())
        anchor = np.fromiter((e[1] for e in entries), np.uint64, len(entries))
        part = ((anchor >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((stretch, part))
        ends = np.searchsorted(part[order], np.arange(ranges + 1))
        rows: dict[str, list] = {"part": [], **{n: [] for n in names}}
        for r in np.flatnonzero(np.diff(ends)).tolist():
            mine = order[ends[r] : ends[r + 1]]
            sent = [entries[i] for i in mine]
            whole = mine[[e[0] > 0 for e in sent]]
            rows["part"].append(r)
            rows["stretches"].append(stretch[mine].tobytes())
            rows["counts"].append(np.array([e[0] for e in sent], np.uint16).tobytes())
            rows["lows"].append(lows[np.searchsorted(known, stretch[whole])].tobytes())
            rows["contexts"].append(b"".join([e[2] for e in sent]))
        block = pa.array(np.full(len(rows["part"]), _block(table)), pa.int32())
        return pa.table({"part": pa.array(rows["part"], pa.int32()), "block": block, **{n: pa.array(rows[n], pa.binary()) for n in names}})

    return run


def _settled_windows(depth: int):
    def run(table: pa.Table) -> pa.Table:
        """Windows that a document with a smaller id has in another stretch, to each block with the stretch."""
        stretch, count, block = _column(table, "stretches", np.uint64), _column(table, "counts", np.uint16), _by_block(table, "stretches", 8)
        low = _column(table, "lows", np.int64)
        whole = np.flatnonzero(count)
        n = count[whole].astype(np.int64)
        buffer = np.frombuffer(b"".join(table.column("contexts").to_pylist()), np.uint8)
        start = np.cumsum(n + depth - 1) - (n + depth - 1)
        owner = np.repeat(np.arange(len(whole)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = start[owner] + offset
        key = spans_hash(prefix_hash(BYTE_VALUES[buffer]), inverse_powers(len(buffer)), at, at + depth)
        order = np.lexsort((low[owner], key))
        k = key[order]
        new = np.append(True, k[1:] != k[:-1])[: len(k)]
        least = np.empty(len(key), np.int64)
        least[order] = low[owner[order]][np.flatnonzero(new)[np.cumsum(new) - 1]]
        better = np.flatnonzero(least < low[owner])
        of = stretch[whole][owner[better]]
        order = np.argsort(of, kind="stable")
        of, better = of[order], better[order]
        # Every block that named the stretch gets its windows.
        first, last = np.searchsorted(of, stretch, side="left"), np.searchsorted(of, stretch, side="right")
        times = last - first
        entry = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        to = np.repeat(block, times)
        columns = {"keys": of[entry], "offsets": offset[better][entry].astype(np.uint16), "lows": least[better][entry]}
        return _answers(to, np.ones(len(to), bool), columns)

    return run


def _known_stretches(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, lows = _column(answers, "keys", np.uint64), _column(answers, "lows", np.int64)
    mixed = _column(answers, "mixed", np.uint8).astype(bool)
    order = np.lexsort((lows, keys))
    return keys[order], lows[order], mixed[order]


def covered(w: Windows, ids: np.ndarray, stretches: tuple, windows: tuple) -> np.ndarray:
    """Sorted (start, end) of the bytes that windows of documents with smaller ids cover."""
    if not len(w.low):
        return np.zeros((0, 2), np.int64)
    known, lows, mixed = stretches
    keys = w.stretch_keys(np.arange(len(w.low)))
    at, found = _found(keys, known)
    which = np.flatnonzero(found)
    at = at[which]
    own = ids[w.doc[which]]
    whole = lows[at] < own
    starts, ends = [w.low[which[whole]]], [w.high[which[whole]] + w.depth]
    part = which[~whole & mixed[at]]
    of, offset, low = windows
    first, last = np.searchsorted(of, keys[part], side="left"), np.searchsorted(of, keys[part], side="right")
    times = last - first
    entry = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
    place = np.repeat(part, times)
    hit = low[entry] < ids[w.doc[place]]
    start = w.low[place[hit]] + offset[entry[hit]]
    starts.append(start)
    ends.append(start + w.depth)
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start, kind="stable")
    return np.stack((start[order], end[order]), axis=1)


def _remove(depth: int, kmer: int, schema: pa.Schema):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        kind = np.asarray(answers.column("kind").combine_chunks() if answers.num_rows else pa.array([], pa.int32()))
        stretches = _known_stretches(answers.filter(pa.array(kind == 2)))
        single = answers.filter(pa.array(kind == 3))
        keys, lows, offsets = _column(single, "keys", np.uint64), _column(single, "lows", np.int64), _column(single, "offsets", np.uint16)
        order = np.argsort(keys, kind="stable")
        windows = keys[order], offsets[order].astype(np.int64), lows[order]
        sizes, spans, kept = [], [], []
        for _, ids, texts, w in windows_of(table, depth, kmer):
            cover = covered(w, ids, stretches, windows)
            offset = 0
            ends = np.cumsum([len(t) for t in texts])
            at = np.searchsorted(cover[:, 0], np.concatenate(([0], ends)))
            for i, text in enumerate(texts):
                runs: list[list[int]] = []
                for start, end in (cover[at[i] : at[i + 1]] - offset).tolist():
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                left, last = [], 0
                for start, end in runs:
                    left.append(text[last:start])
                    last = end
                left.append(text[last:])
                sizes.append(len(text))
                spans.append([{"start": a, "length": b - a} for a, b in runs])
                kept.append(b"".join(left))
                offset += len(text)
        made = [pa.array(sizes, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())]
        out = table.drop_columns(["block", "_id", "_bytes"])
        return pa.table([*out.columns, *made], schema=schema)

    return run


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, kmer: int = KMER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_bytes``, ``spans`` removed (start, length) and the ``kept`` bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in (*RESULTS, "block", "_id", "_bytes") if c not in (text, doc_id)])
    others = [c for c in docs.columns if c != text]
    blocks = n_blocks(docs, text, block_bytes)
    # A range of keys holds about RANGE_BYTES: one key of eight bytes for about fourteen bytes of text.
    ranges = max(1, blocks * block_bytes * 8 // 14 // RANGE_BYTES)
    keyed = docs.withColumn("_id", F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))).withColumn("_bytes", F.col(text).cast("binary"))
    keyed = with_blocks(keyed, doc_id, "_bytes", blocks).select(*others, "block", "_id", "_bytes")
    texts = keyed.select("block", "_id", "_bytes")

    def answered(sent: DataFrame, settle, schema: str, name: str) -> DataFrame:
        sent = cut(sent, f"{name}-keys")
        answers = cut(sent.groupBy("part").applyInArrow(settle, schema), f"{name}-answers")
        release(sent)
        return answers

    packed = "part int, block int, "
    anchors = texts.groupBy("block").applyInArrow(_anchors(ranges, depth, kmer), packed + "keys binary, shared binary")
    anchors = answered(anchors, _shared_anchors, "block int, keys binary", "anchor")
    pair = lambda answers: texts.groupBy("block").cogroup(answers.groupBy("block"))
    stretches = pair(anchors).applyInArrow(_stretches(ranges, depth, kmer), packed + "keys binary, stretches binary, lows binary")
    stretches = answered(stretches, _settled_stretches, "block int, keys binary, lows binary, mixed binary", "stretch")
    release(anchors)
    mixed = pair(stretches).applyInArrow(_mixed_stretches(ranges, depth, kmer), packed + "stretches binary, counts binary, lows binary, contexts binary")
    single = answered(mixed, _settled_windows(depth), "block int, keys binary, offsets binary, lows binary", "window")

    answers = stretches.withColumn("kind", F.lit(2)).unionByName(single.withColumn("kind", F.lit(3)), allowMissingColumns=True)
    for packed_column in ("mixed", "offsets"):
        answers = answers.withColumn(packed_column, F.coalesce(packed_column, F.lit(b"")))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return keyed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(depth, kmer, to_arrow_schema(schema)), schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Remove from every text of ``documents`` what also starts in a document with a smaller id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = suffix_dedup(docs)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Every window of 50 bytes (100 hex digits, cut from pieces of 249 bytes) with the smallest id that holds it.
OP6_SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), piece AS (
  SELECT doc_id, o, substr(h, 2 * o + 1, 498) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 200)) AS o FROM docs)
), byte AS (
  SELECT doc_id, o + q AS p, substr(s, 2 * q + 1, 100) AS w
  FROM (SELECT doc_id, o, s, unnest(range(0, least(200, length(s) // 2))) AS q FROM piece)
), earliest AS (
  SELECT w, min(doc_id) AS lo FROM byte WHERE length(w) = 100 GROUP BY w
), start AS (
  SELECT doc_id, p, substr(w, 1, 2) AS b, coalesce(lo < doc_id, FALSE) AS s FROM byte LEFT JOIN earliest USING (w)
), cover AS (
  SELECT doc_id, p, b, bool_or(s) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS c FROM start
), run AS (
  SELECT doc_id, p, b, c, c AND NOT coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS opens FROM cover
), summed AS (
  SELECT doc_id, count(*) FILTER (c) AS n_removed, count(*) FILTER (opens) AS n_spans,
         coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT c), '') AS kept
  FROM run GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN summed USING (doc_id)
"""
