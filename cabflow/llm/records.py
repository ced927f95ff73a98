"""Token ids as length-delimited binary records (operator 8).

File format, all integers little-endian. A shard file is a sequence of
records; a record is

    8 bytes  length n of the payload
    4 bytes  masked CRC-32 of those 8 bytes
    n bytes  payload
    4 bytes  masked CRC-32 of the payload

and a payload is

    8 bytes  document id (signed; 0 if it is null)
    1 byte   width of an id in bytes (2 or 4), plus 128 if the id is null
    the ids, each of that width

The mask rotates the checksum right by 15 bits and adds 0xA282EAD8, so that
a checksum of data that holds checksums stays meaningful. The index is a
Parquet table beside the shards: doc_id, shard, offset, n_bytes, start,
n_tokens; one row per record, so a reader can fetch records in any order.

Writing: documents are range-partitioned and sorted by id (one shuffle of
the texts), and each task writes its shard through a draft name that is
renamed at the end; a task run again on another executor writes the same
bytes. ``start`` adds up the shards' totals, one small row each.

Defined cases: a null or empty text is a record of the end id alone;
repeated document ids are all written, in the order of their texts; a null
document id is refused by an error unless ``null_ids`` asks for records of
such rows, which come last and are addressed by their index row; an empty
table gives an empty index. Other columns are not stored.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cabflow.llm.bpe_vocab import byte_alphabet, vocabulary
from cabflow.llm.common import cut, gathered, prepare, scratch_path
from cabflow.llm.files import locate, writing
from cabflow.llm.pieces import NONE, Ragged, Remembered, flat_bytes, spaced_pieces, texts_of

#: Documents a shard is meant to hold, pieces whose ids a worker remembers, pre-tokens handed to the library together.
SHARD_ROWS, REMEMBERED, WORDS = 8192, 1_000_000, 2_000
#: Text bytes encoded together.
SLICE_BYTES = 16 << 20

_HEAD, _BODY, _NULL_ID = "<Q", "<qB", 128


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return struct.pack("<I", (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    head = struct.pack(_HEAD, len(payload))
    return b"".join((head, masked(head), payload, masked(payload)))


def unframe(record: bytes) -> bytes:
    """The payload of one record; raises ``ValueError`` if anything is damaged."""
    if len(record) < 16 or masked(record[:8]) != record[8:12]:
        raise ValueError("damaged record length")
    (n,) = struct.unpack_from(_HEAD, record)
    if len(record) != n + 16 or masked(record[12 : 12 + n]) != record[12 + n :]:
        raise ValueError("damaged record payload")
    return record[12 : 12 + n]


class Encoder:
    """Ids by the ``tokenizers`` library, remembered by piece.

    A piece is cut into its pre-tokens, each of which the library encodes
    alone as it does inside a text. Plain pre-tokens go to the library's
    model many at a time, in its byte-level alphabet; pieces that only the
    library can cut go to it as they are.
    """

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        self.vocab = vocabulary(tokenizer)
        self.library = self.vocab.library
        self.model = Tokenizer(self.library.model)  # takes pre-tokens as they are
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.alphabet = np.zeros(256, "<u4")
        for char, byte in byte_alphabet().items():
            self.alphabet[byte] = ord(char)
        self.pieces = Remembered(self._pieces, REMEMBERED)

    def _words(self, words: pa.Array) -> Ragged:
        """Ids of distinct pre-tokens."""
        raw, edges = flat_bytes(words)
        text, ends = self.alphabet[raw].tobytes().decode("utf-32-le"), edges.tolist()
        spelled = [text[a:b] for a, b in zip(ends[:-1], ends[1:])]
        values, sizes = [], []
        for at in range(0, len(spelled), WORDS):
            some = spelled[at : at + WORDS]
            found = self.model.encode_batch([some], is_pretokenized=True, add_special_tokens=False)[0]
            values.append(np.array(found.ids, np.int32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
        return Ragged(np.concatenate(values), np.concatenate(sizes)) if values else NONE

    def _pieces(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct pieces."""
        plain, words, counts = self.vocab.cut_runs(pieces)
        coded = words.dictionary_encode()
        found = self._words(coded.dictionary).take(np.asarray(coded.indices, np.int64)).joined(counts)
        others = pieces.filter(pa.array(~plain)).to_pylist()
        others = Ragged.of([x.ids for x in self.library.encode_batch_fast(others, add_special_tokens=False)])
        back = np.argsort(np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain))))
        return found.followed_by(others).take(back)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text."""
        pieces, counts = spaced_pieces(texts)
        ids = self.pieces.of(pieces).joined(counts)
        packed = ids.values.astype(self.dtype).tobytes()
        edges = (np.append(ids.starts, len(ids.values)) * self.width).tolist()
        return [packed[a:b] for a, b in zip(edges[:-1], edges[1:])]


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int, text: str = "text", key: str = "doc_id", shard_rows: int = SHARD_ROWS, null_ids: bool = False) -> DataFrame:
    """Encode ``text``, write record files under ``path`` in ascending ``key`` order; returns the index."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = max(1, -(-docs.count() // shard_rows))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        shard = f"shard-{TaskContext.get().partitionId():06d}.rec"
        rows: list[tuple[int, int, int, int]] = []
        at = 0
        first = next(batches, None)
        if first is None:
            return
        with writing(f"{path}/{shard}") as out:
            for batch in gathered(itertools.chain([first], batches), "text", SLICE_BYTES):
                found = [x for c in batch.column(1).chunks for x in encoder.encode(texts_of(c))]
                for doc, ids in zip(batch.column(0).to_pylist(), found):
                    if doc is None and not null_ids:
                        raise ValueError(f"{key} is null")
                    head = struct.pack(_BODY, doc or 0, encoder.width | (_NULL_ID if doc is None else 0))
                    record = frame(head + ids + end)
                    rows.append((doc, at, len(record), len(ids) // encoder.width + 1))
                    out.write(record)
                    at += len(record)
        doc, offset, size, n = zip(*rows)
        arrays = [pa.array(doc, pa.int64()), pa.array([shard] * len(doc)), pa.array(offset, pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "shard", "offset", "n_bytes", "n_tokens"])

    # Null ids last; there may be many, so their texts take part in the ranges.
    place = [F.col("doc_id").asc_nulls_last(), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))]
    ordered = docs.repartitionByRange(shards, *place).sortWithinPartitions(*place, "text")
    index = cut(ordered.mapInArrow(write, "doc_id long, shard string, offset long, n_bytes long, n_tokens long"), "record-index")
    # One row per shard: the ids before it.
    before = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    index = index.join(before, "shard").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    index.select("doc_id", "shard", "offset", "n_bytes", "start", "n_tokens").write.mode("overwrite").parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, shard string, offset long, n_bytes long, start long, n_tokens long").parquet(f"{path}/index")


def read_records(index: DataFrame, path: str, results: tuple[str, ...] = ("ids",)) -> DataFrame:
    """The records that ``index`` names (any rows of it, in any order), each checked against its checksums.

    Adds ``n_ids`` and any of ``ids`` (array) and ``ids_crc32`` (of the ids
    as unsigned 32-bit integers). Neighbouring records are fetched together.
    """
    prepare(index.sparkSession)
    types = {"ids": "array<long>", "ids_crc32": "long"}
    columns = ["doc_id", "start", "shard", "offset", "n_bytes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = locate(path)
        name, file = None, None
        for batch in batches:
            rows = batch.to_pydict()
            counts, ids, crcs = [], [], []
            for doc, shard, offset, size in zip(rows["doc_id"], rows["shard"], rows["offset"], rows["n_bytes"]):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, where.open_input_file(f"{root}/{shard}")
                payload = unframe(file.read_at(size, offset))
                stored, width = struct.unpack_from(_BODY, payload)
                if width & _NULL_ID:
                    stored, width = None, width ^ _NULL_ID
                if stored != doc:
                    raise ValueError(f"{shard} at {offset} holds document {stored}, not {doc}")
                found = np.frombuffer(payload, np.dtype(f"<u{width}"), offset=struct.calcsize(_BODY))
                counts.append(len(found))
                if "ids" in results:
                    ids.append(found.astype(np.int64))
                if "ids_crc32" in results:
                    crcs.append(zlib.crc32(found.astype("<u4").tobytes()))
            out = {"ids": lambda: pa.array(ids, pa.list_(pa.int64())), "ids_crc32": lambda: pa.array(crcs, pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), *(out[c]() for c in results)], names=["doc_id", "start", "n_ids", *results])
        if file is not None:
            file.close()

    schema = "doc_id long, start long, n_ids long" + "".join(f", {c} {types[c]}" for c in results)
    return index.select(*columns).mapInArrow(read, schema)


def op8_token_records(spark, sf_dir: str) -> DataFrame:
    """Write the ids of every text of ``documents`` as records, read them back, digest them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch_path(spark, "token-records")
    index = write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2, null_ids=True)
    read = read_records(index, path, results=("ids_crc32",))
    return read.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
