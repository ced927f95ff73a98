r"""Quality rules by cross-document line frequency (operator 2).

A line is normalised (ASCII letters lowered, white space collapsed) and
hashed; its frequency is the number of distinct documents of the same host
that hold it, where copies of one text are one document. Lines found in more
than ``max_share`` of the host's documents or ``max_docs``, whichever is less,
but at least ``min_docs``, are removed. A document is rejected if it fails the base rules (too few words,
or too many words inside repeated five-word windows) or if removal depletes
it (fewer than ``min_words`` words left, or less than ``min_left`` of them).

Steps: one narrow Python pass measures each text and hashes its lines; the
profiles are written once per distinct (host, text) and everything after
works on them, without the texts. Line counts are combined in the tasks
before the shuffle, so a line that a third of all documents share sends one
row a task. Verdicts return by (host, text digest).

Words are ``[^\x20\x09-\x0D]+``. Defined cases: a null text has no words and
fails the base rules; a null host is the host ``''``; blank lines are never
removed; repeated rows get the same verdict each; columns of the input named
like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cabflow.llm.common import cut, prepare, slices, text_bytes

WINDOW = 5
#: Text bytes measured together.
SLICE_BYTES = 2 << 20
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*METRICS, "base_failed", "n_removed_lines", "n_kept_words", "kept")

_SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more in the text."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(windows) == len(set(windows)):
        return 0
    times = Counter(windows)
    covered, until = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + WINDOW - max(at, until)
            until = at + WINDOW
    return covered


def line_hash(words: list[bytes]) -> int:
    """Signed 64-bit hash of a normalised line."""
    return xxhash.xxh3_64_intdigest(b" ".join(words).lower()) - (1 << 63)


def measure(text: bytes) -> tuple[tuple[int, ...], list[tuple[int, int, int]]]:
    """The metrics of a text, and (position, hash, words) of each line with a word."""
    words: list[bytes] = []
    lines, seen, duplicates = [], set(), 0
    for at, line in enumerate(text.split(b"\n")):
        own = line.split()
        if own:
            duplicates += line in seen
            seen.add(line)
            lines.append((at, line_hash(own), len(own)))
            words += own
    characters = len(text.decode()) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    return (len(words), characters, symbols, duplicates, repeated_words(words)), lines


_PROFILE = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("key", T.StringType())]
    + [T.StructField(m, T.LongType()) for m in METRICS]
    + [T.StructField("lines", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("words", T.IntegerType())])))]
)
_LINES = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
        found = [measure(t) for t in text_bytes(batch.column(2))]
        metrics = [pa.array([m[k] for m, _ in found], pa.int64()) for k in range(len(METRICS))]
        lines = pa.array([[{"at": a, "hash": h, "words": w} for a, h, w in ls] for _, ls in found], _LINES)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *metrics, lines], names=[f.name for f in _PROFILE.fields])


def keyed(docs: DataFrame, text: str, host: str) -> DataFrame:
    return docs.withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit(""))).withColumn("_key", F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def verdicts(docs: DataFrame, text: str, host: str, max_share: float, min_docs: int, max_docs: int, min_words: int, min_left: float, max_repeat: float) -> DataFrame:
    """One row per distinct (host, text): metrics, verdict, positions of removed lines."""
    rows = keyed(docs, text, host).select(F.col("_host").alias("host"), F.col("_key").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    profiles = cut(rows.mapInArrow(profile, _PROFILE).dropDuplicates(["host", "key"]), "line-profiles")
    hosts = profiles.groupBy("host").agg(F.count("*").alias("docs"))
    lines = profiles.select("host", F.explode(F.array_distinct(F.col("lines.hash"))).alias("hash"))
    counted = lines.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    limit = F.greatest(F.lit(float(min_docs)), F.least(F.lit(max_share) * F.col("docs"), F.lit(float(max_docs))))
    frequent = counted.join(hosts, "host").where(F.col("n") > limit).select("host", "hash")
    frequent = cut(frequent, "frequent-lines")
    removed = (
        profiles.select("host", "key", F.explode("lines").alias("line"))
        .select("host", "key", "line.*")
        .join(frequent, ["host", "hash"], "left_semi")
        .groupBy("host", "key")
        .agg(F.count("*").alias("n_removed_lines"), F.sum("words").alias("gone"), F.collect_list("at").alias("removed"))
    )
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > F.lit(100 * max_repeat) * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return (
        profiles.drop("lines")
        .join(removed, ["host", "key"], "left")
        .withColumn("base_failed", base_failed)
        .withColumn("n_removed_lines", F.coalesce("n_removed_lines", F.lit(0)).cast("long"))
        .withColumn("n_kept_words", left.cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= F.lit(min_left) * F.col("n_words")))
        .select(F.col("host").alias("_host"), F.col("key").alias("_key"), *RESULTS, "removed")
    )


def without_lines(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the lines at the positions ``removed`` cut from ``text``."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, gone in enumerate(batch.column("removed").to_pylist()):
                if gone:
                    gone = set(gone)
                    texts[i] = "\n".join(line for k, line in enumerate(texts[i].split("\n")) if k not in gone)
            yield batch.set_column(at, text, pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    clean: bool = False,
    max_share: float = 0.10,
    min_docs: int = 5,
    max_docs: int = 1000,
    min_words: int = 10,
    min_left: float = 0.3,
    max_repeat: float = 0.2,
) -> DataFrame:
    """``docs`` with the metrics, ``base_failed``, ``n_removed_lines``, ``n_kept_words`` and ``kept``.

    A line goes from a host's documents if more of them than ``max_share`` of
    all hold it, or more than ``max_docs``, but never for ``min_docs`` or
    fewer: a large host's limit does not grow without end. With ``clean``,
    ``text`` is without the removed lines; the metrics are always those of
    the input text. Columns named like a result are replaced; ``removed``,
    ``_host`` and ``_key`` of the input are left out.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in (*RESULTS, "removed", "_host", "_key") if c not in (text, host)])
    verdict = verdicts(docs, text, host, max_share, min_docs, max_docs, min_words, min_left, max_repeat)
    out = keyed(docs, text, host).join(verdict, ["_host", "_key"], "left")
    if clean:
        out = without_lines(out, text)
    return out.select(*docs.columns, *RESULTS)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return quality_rules(docs).drop("source", "text")


OP2_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), measured AS (
  SELECT rid, doc_id, host, t,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM docs
), word AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM measured
), win AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d || ' ' || lead(w, 4) OVER d AS s
  FROM word WINDOW d AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i FROM win WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid
), raw_line AS (
  SELECT rid, host, t, unnest(string_split(t, chr(10))) AS l FROM docs
), line AS (
  SELECT rid, host, t, l,
         translate(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
         length(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw
  FROM raw_line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM line GROUP BY rid
), host_docs AS (
  SELECT host, count(DISTINCT t) AS docs FROM docs GROUP BY host
), frequent AS (
  SELECT host, norm FROM line JOIN host_docs USING (host)
  GROUP BY host, norm, docs HAVING count(DISTINCT t) > greatest(5.0, least(0.10 * docs, 1000.0))
), gone AS (
  SELECT rid, count(*) AS n_removed_lines, sum(nw) AS gone FROM line JOIN frequent USING (host, norm) GROUP BY rid
), base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
         (len(ws) - coalesce(gone, 0))::BIGINT AS n_kept_words
  FROM measured LEFT JOIN repeats USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN gone USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       n_removed_lines, n_kept_words,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND n_kept_words >= 10 AND n_kept_words >= 0.3 * n_words AS kept
FROM base
"""
