"""Token counts by heap-and-linked-list byte-pair merging (operator 10).

A word starts as a linked list of its symbols. A heap holds every adjacent
pair that has a merge, keyed by (rank, position); the lowest is popped and
merged until none is left. The count is the initial symbols minus the
merges; no identifier leaves the operator.

One narrow pass: each row's whole text is cut into pieces that tokenise
independently, counts of pieces are remembered in a bounded table of the
Python worker. No shuffle, no driver work; a lost executor's task is
simply run again.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special
strings inside a text count as one token each, as in the library's default;
repeated rows are counted once per row; all other columns pass through.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cabflow.llm.bpe_vocab import Memo, spaced_pieces, vocabulary
from cabflow.llm.common import prepare

#: Pieces whose count a worker remembers.
REMEMBERED = 400_000


def merged_length(symbols: list[int], ranks: dict[int, dict[int, int]], made: list[int]) -> int:
    """Number of symbols left after all merges, lowest rank first, leftmost on ties.

    A heap entry is rank and position in one integer.
    """
    count = len(symbols)
    if count < 2:
        return count
    shift = count.bit_length()
    mask = (1 << shift) - 1
    none: dict[int, int] = {}
    heap = []
    left = symbols[0]
    for at in range(1, count):
        right = symbols[at]
        rank = ranks.get(left, none).get(right)
        if rank is not None:
            heap.append(rank << shift | (at - 1))
        left = right
    heapq.heapify(heap)
    after = list(range(1, count + 1))  # the place after the last is the end
    before = list(range(-1, count))
    end = count
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        at = entry & mask
        right = after[at]
        symbol = symbols[at]
        # A pair that a neighbour's merge has changed is stale.
        if symbol < 0 or right == end or ranks.get(symbol, none).get(symbols[right]) != entry >> shift:
            continue
        symbols[at] = symbol = made[entry >> shift]
        symbols[right] = -1
        count -= 1
        after[at] = right = after[right]
        if right != end:
            before[right] = at
            rank = ranks.get(symbol, none).get(symbols[right])
            if rank is not None:
                push(heap, rank << shift | at)
        left = before[at]
        if left >= 0:
            rank = ranks.get(symbols[left], none).get(symbol)
            if rank is not None:
                push(heap, rank << shift | left)
    return count


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> tuple[Memo, Memo]:
    """Remembered counts of pieces and of the words of pieces that hold several."""
    vocab = vocabulary(path)
    count_word = lambda word: merged_length(vocab.symbols(word), vocab.ranks, vocab.made)
    words = Memo(count_word, REMEMBERED // 2)

    def count_piece(piece: str) -> int:
        found = vocab.words(piece)
        if len(found) == 1 and not isinstance(found[0], int):
            return count_word(found[0])
        return sum(1 if isinstance(w, int) else words[w] for w in found)

    return Memo(count_piece, REMEMBERED), words


def count_text(text: str, path: str) -> int:
    """Tokens of one text."""
    return sum(map(_counter(path)[0].__getitem__, spaced_pieces(text)))


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` for the column ``text``.

    ``tokenizer`` is the path of a byte-level BPE file (``.json``), readable
    at that path on every executor. Columns of ``docs`` named like a result
    column are replaced.
    """
    prepare(docs.sparkSession)
    made = ["n_bytes", "n_tokens", "over_limit"]
    docs = docs.drop(*[c for c in made if c != text])
    schema = T.StructType(
        docs.schema.fields
        + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            counts = [count_text(t, tokenizer) if t else 0 for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=[*batch.schema.names, *made],
            )

    return docs.mapInArrow(run, schema)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")
