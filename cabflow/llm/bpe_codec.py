"""BPE encoding and decoding through a transducer lexicon (operator 9).

1. Count the white-space separated pieces of all texts (tasks add up their
   own pieces first; one shuffle of distinct pieces).
2. The most frequent ``lexicon_size`` of them, a bounded list, are cut
   into words, merged and compiled into a minimal acyclic transducer whose
   path sums index id sequences (``lexicon.py``). The file is written to the
   shared folder and handed to the executors with ``addFile``; they map it
   into memory.
3. One narrow pass encodes: the words of pieces not seen lately are looked
   up in the transducer together; words it lacks are merged exactly by rank.
   Ids do not depend on what the lexicon holds, only the speed does. Pieces,
   words and ids stay flat arrays (``pieces.py``), as do the texts decoded
   from the ids.

Defined cases: a null or empty text (also one of white space only) has no
ids and decodes to the empty text; special strings inside a text are their
special ids; repeated rows are encoded once per row; other columns pass
through, those named like a result are replaced; ties in the frequency list
are broken by a hash of the piece.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cabflow.llm.bpe_vocab import vocabulary
from cabflow.llm.common import cut, gathered, most_frequent, prepare, release, scratch_path, slices
from cabflow.llm.files import put_bytes
from cabflow.llm.lexicon import build, lexicon
from cabflow.llm.pieces import Ragged, Remembered, flat_bytes, strings, texts_of, white_pieces

LEXICON_SIZE = 65_536
#: Pieces whose ids a worker remembers.
REMEMBERED = 300_000
#: Text bytes encoded together, and text bytes whose pieces are counted together.
SLICE_BYTES, COUNT_BYTES = 4 << 20, 8 << 20


def frequent_pieces(docs: DataFrame, text: str, size: int) -> list[str]:
    """The ``size`` most frequent white-space separated pieces of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, text, COUNT_BYTES):
            pieces = pa.chunked_array([white_pieces(texts_of(c))[0] for c in table.column(0).chunks], pa.large_string())
            found = pc.value_counts(pieces).filter(pc.not_equal(pc.unique(pieces), ""))
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["piece", "n"])

    counted = docs.select(text).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counted = cut(counted.select("piece", "n", F.xxhash64("piece").alias("key")), "pieces")
    found = [r["piece"] for r in most_frequent(counted, size, "key")]
    release(counted)
    return found


def compile_lexicon(pieces: list[str], tokenizer: str) -> bytes:
    """Serialised transducer of the words of ``pieces`` (a bounded list)."""
    vocab = vocabulary(tokenizer)
    words = list({w for piece in pieces for w in vocab.words(piece) if isinstance(w, bytes)})
    return build(dict(zip(words, vocab.merge_words(words))))


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, tokenizer: str, lexicon_file: str):
        self.vocab = vocabulary(tokenizer)
        self.lexicon = lexicon(lexicon_file)
        ids = range(max(self.vocab.token) + 1)
        #: Spellings of the ids, each with a space behind it.
        self.decimal = pa.array((f"{i} " for i in ids), pa.large_string())
        self.token = pa.array((self.vocab.token.get(i, "") + " " for i in ids), pa.large_string())
        self.pieces = Remembered(self._pieces, REMEMBERED)

    def _words(self, words: pa.Array) -> Ragged:
        """Ids of distinct words: from the transducer, or merged."""
        index = self.lexicon.find_array(words)
        lacking = index < 0
        merged = self.vocab.merge_array(words.filter(pa.array(lacking)))
        index[lacking] = np.arange(len(merged))
        table = self.lexicon.table.take(index[~lacking])
        index[~lacking] = len(merged) + np.arange(len(table))
        return merged.followed_by(table).take(index)

    def _pieces(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct pieces."""
        plain, words, counts = self.vocab.cut_runs(pieces)
        coded = words.dictionary_encode()
        found = self._words(coded.dictionary).take(np.asarray(coded.indices, np.int64)).joined(counts)
        # The others word by word; some of their words are special ids.
        cut = self.vocab.cut_pieces(pieces.filter(pa.array(~plain)).cast(pa.large_binary()).to_pylist())
        each = [w.encode() if isinstance(w, str) else w for w in chain.from_iterable(cut)]
        words = list({w for w in each if isinstance(w, bytes)})
        special = list({w for w in each if isinstance(w, int)})
        table = self._words(pa.array(words, pa.large_binary())).followed_by(Ragged.of([[i] for i in special]))
        place = {w: k for k, w in enumerate([*words, *special])}
        others = table.take(np.array([place[w] for w in each], np.int64)).joined(np.array([len(ws) for ws in cut], np.int64))
        back = np.argsort(np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain))))
        return found.followed_by(others).take(back)

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of each text."""
        pieces, counts = white_pieces(texts)
        return self.pieces.of(pieces).joined(counts)

    @staticmethod
    def spelled(ids: Ragged, spelling: pa.Array) -> pa.Array:
        """The spellings of each row's ids, joined by one space."""
        raw, edges = flat_bytes(spelling.take(pa.array(ids.values)))
        ends, some = edges[ids.starts + ids.sizes], ids.sizes > 0
        kept = np.ones(len(raw), bool)
        kept[ends[some] - 1] = False  # the space behind the last
        return strings(raw[kept], np.concatenate(([0], ends - np.cumsum(some))))


def digests(texts: pa.Array) -> pa.Array:
    """Sha256 of each text."""
    raw, edges = flat_bytes(texts)
    ends = edges.tolist()
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string())


def decode(ids: list[int], tokenizer: str) -> str:
    """The text of ``ids`` as the library's ``decode`` without a decoder gives it."""
    token = vocabulary(tokenizer).token
    return " ".join(token[i] for i in ids if i in token)


@functools.lru_cache(maxsize=1)
def _codec(tokenizer: str, lexicon_file: str) -> Codec:
    return Codec(tokenizer, lexicon_file)


def ship_lexicon(docs: DataFrame, tokenizer: str, text: str, size: int) -> str:
    """Build the lexicon of ``docs`` and hand its file to the executors; the file's name."""
    spark = docs.sparkSession
    data = compile_lexicon(frequent_pieces(docs, text, size), tokenizer)
    path = scratch_path(spark, "lexicon") + ".bin"
    put_bytes(path, data)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def bpe_codec(docs: DataFrame, tokenizer: str, text: str = "text", results: tuple[str, ...] = ("n_tokens", "ids", "decoded"), lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """``docs`` with any of ``n_tokens``, ``ids``, ``decoded``, ``ids_sha256``, ``decoded_sha256``.

    ``tokenizer`` is the path of a word-level BPE file without a decoder
    (words end in a mark, white space is dropped), readable at that path on
    every executor. ``decoded`` is the text that decoding the ids gives.
    """
    spark = docs.sparkSession
    prepare(spark)
    types = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    docs = docs.drop(*[c for c in results if c != text])
    name = ship_lexicon(docs, tokenizer, text, lexicon_size)
    schema = T.StructType(docs.schema.fields + [T.StructField(c, types[c]) for c in results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer, SparkFiles.get(name))
        try:
            for whole in batches:
                for batch in slices(whole, text, SLICE_BYTES):
                    ids = codec.encode(texts_of(batch.column(text)))
                    out: dict[str, pa.Array] = {"n_tokens": pa.array(ids.sizes)}
                    if "ids" in results:
                        out["ids"] = pa.ListArray.from_arrays(ids.edges(), pa.array(ids.values, pa.int32()))
                    if "ids_sha256" in results:
                        out["ids_sha256"] = digests(codec.spelled(ids, codec.decimal))
                    if "decoded" in results or "decoded_sha256" in results:
                        decoded = codec.spelled(ids, codec.token)
                        out |= {"decoded": decoded.cast(pa.string()), "decoded_sha256": digests(decoded)}
                    yield pa.RecordBatch.from_arrays([*batch.columns, *(out[c] for c in results)], names=[*batch.schema.names, *results])
        finally:
            codec.pieces.forget()  # the worker lives on

    return docs.mapInArrow(run, schema)


def op9_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    results = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe_codec(docs, public_tokenizers.path("word_bpe_49k.json"), results=results).drop("text")
