"""Helpers shared by the corpus operators: lineage cuts, blocks, word hashing.

Nothing here keeps state between calls apart from per-process caches of
read-only vocabularies.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabflow.session import shared_dir

#: Arrow batches handed to Python hold at most so many rows and bytes.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Shuffle files of a query that wrote a table are deleted when it ends:
    # the written table, not the shuffle, is what later steps read.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

#: Python workers live on between tasks; so that memory which one task needed
#: goes back to the system, large blocks are mapped and freed ones trimmed.
WORKER_ENV = {
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(4 << 20),
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}

#: Words are maximal runs of bytes other than these.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session and let its Python workers import this package.

    These settings are the operators' one side effect. A cluster installs
    the package or names it in ``--py-files``; the path added here serves
    sessions that were started without either, on machines that have it.
    """
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for key, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(key, value)
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is missing, a session in one process gets a temporary
    folder of its own; on a cluster that is an error.
    """
    try:
        root = shared_dir(spark)
    except RuntimeError:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise
        root = tempfile.mkdtemp(prefix="cabflow-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cabflow-llm/{name}-{uuid.uuid4().hex}"


#: Buckets that Spark lets a table have by default.
MAX_BUCKETS = 100_000


def cut_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``cut``, bucketed by ``key``: groups of it are read back without a shuffle.

    Spark takes buckets from its catalog; the entry goes at once, the files and
    what is returned stay.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"cabflow_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(min(buckets, MAX_BUCKETS), key).saveAsTable(table)
    _WRITTEN.append(path)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


#: Folders of ``cut`` that this driver has written and not deleted.
_WRITTEN: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without
    recomputing what came before. The folder belongs to the job; the
    platform's expiry of ``spark.checkpoint.dir`` removes it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Folders of ``cut`` that are still there."""
    return list(_WRITTEN)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders of ``cut`` that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN[:] = [p for p in _WRITTEN if p not in set(paths)]


def tables_of(df: DataFrame) -> set[str]:
    """The folders of ``cut`` that ``df`` reads."""
    names = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles() if "/cabflow-llm/" in f}
    return {p for p in _WRITTEN if p.rsplit("/", 1)[-1] in names}


def release(df: DataFrame) -> None:
    """Delete the table behind a ``cut`` that nothing reads any more."""
    delete(df.sparkSession, tables_of(df))


def n_blocks(df: DataFrame, column: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts of ``column`` fill (one narrow pass)."""
    total = df.agg(F.sum(F.octet_length(column).cast("long") + F.lit(64))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def with_blocks(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Add ``block``: rows dealt evenly over ``n`` blocks by a hash of ``key`` and ``text``.

    The text takes part so that rows without a key, or of one key, spread too.
    """
    return df.withColumn("block", F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(7)), F.lit(n)).cast("int"))


#: Counts up to this have a rung of their own; above it a doubling has ``PER_DOUBLING`` rungs.
EXACT_RUNGS, PER_DOUBLING = 1_024, 64


def most_frequent(counts: DataFrame, size: int, key: str) -> list:
    """The ``size`` rows of a written table with the largest ``n`` (1 or more), ties by the smallest ``key`` (a long).

    Rows are counted by rungs of ``n``; all rungs from the top down that fit
    are taken. The first that does not fit is divided further, by ``n`` and
    then by leading bits of the key, while it holds over ``size`` rows. A
    division brings a few thousand numbers to the driver and the end at most
    twice ``size`` rows, however many partitions there are.
    """
    n, k = F.col("n"), F.col(key)
    rung = F.when(n <= EXACT_RUNGS, n.cast("long")).otherwise(F.floor(F.log2(n) * PER_DOUBLING).cast("long") + EXACT_RUNGS)
    levels = [-rung, *(F.shiftright(-n, bits) for bits in (28, 16, 4, 0)), *(F.shiftright(k, bits) for bits in (52, 40, 28, 16, 4, 0))]
    taken, divided, rest = F.lit(False), F.lit(True), size
    for level in levels:
        held = {r["at"]: r["rows"] for r in counts.where(divided).groupBy(level.alias("at")).agg(F.count("*").alias("rows")).collect()}
        last = None
        for at in sorted(held):
            if held[at] > rest:
                break
            last, rest = at, rest - held[at]
        else:
            taken, divided = taken | divided, F.lit(False)
            break
        if last is not None:
            taken = taken | (divided & (level <= last))
        divided = divided & (level == at)
        if held[at] <= size:
            break
    return sorted(counts.where(taken | divided).collect(), key=lambda r: (-r["n"], r[key]))[:size]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


# --------------------------------------------------------------- hashing

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)


#: Powers by base, kept for the next call: one table a base, of at most so many.
_POWERS: dict[int, np.ndarray] = {}
KEPT_POWERS, POWERS_STEP = 1 << 22, 1 << 18


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    """``base ** 0 .. base ** n`` (mod 2**64)."""
    out = _POWERS.get(int(base))
    if out is None or len(out) <= n:
        out = np.full((n // POWERS_STEP + 1) * POWERS_STEP, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if len(out) <= KEPT_POWERS:
            _POWERS[int(base)] = out
    return out[: n + 1]


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """``H`` with ``H[j] - H[i] = sum of values[t] * ODD**t for i <= t < j`` (mod 2**64)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[:-1], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the spans; the length takes part."""
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MIX2)


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, _INVERSE)


class Words:
    """Words of a list of texts, as flat arrays.

    ``doc`` is the index of each word's text, ``hash`` its 64-bit hash,
    ``start``/``end`` its byte span in ``buffer`` (texts joined by newline).
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.buffer, np.uint8)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        word = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
        self.start, self.end = edge[::2], edge[1::2]
        prefix = prefix_hash(BYTE_VALUES[raw])
        self.hash = spans_hash(prefix, inverse_powers(len(raw)), self.start, self.end)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first_byte = np.concatenate(([0], np.cumsum(sizes)))
        self.doc = np.searchsorted(self.first_byte, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first_word = np.concatenate(([0], np.cumsum(self.per_doc)))


def parcels(sizes: list[int], most: int) -> Iterator[slice]:
    """Cut a list into runs whose sizes add up to about ``most`` (one item at least)."""
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield slice(at, i)
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield slice(at, len(sizes))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice's texts hold about ``most_bytes`` (one row at least)."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0), np.int64)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(sizes[at:])
        n = max(1, int(np.searchsorted(total, most_bytes, side="right")))
        yield batch.slice(at, n)
        at += n


def gathered(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Batches put together until their texts hold ``most_bytes`` or more; the rows keep their order."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
