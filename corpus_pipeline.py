"""A training corpus from ``documents``: five stages, each one of the corpus operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``docs``, where
``n_chars`` is that of the present text; in the last, results replace columns
of their names.

1. quality rules: lines above the document-frequency limits go, and so do
   documents that fail the rules or are depleted;
2. line dedup: later copies of repeated line runs go, and so do documents of
   which nothing is left;
3. MinHash near-dedup: one document of each class stays;
4. mixing: sources reach their target weights, those poor in data for their
   weight start again, so documents may come several times; the rows are
   written in the order of the schedule (part files by number, rows in them);
5. BPE encoding and decoding: ids, and the digest of what they decode to;
   ``mix_part`` and ``mix_row`` are the row's place in the mix, as Spark reads
   files in no fixed order: sorted by them the rows are in the order of the
   schedule.

A stage whose ``docs`` have been written first deletes the intermediate tables
of the stages before it over the same ``sf_dir``: their results are written,
nothing reads those tables any more. A result that is to be read later than
that has to be written, as the stages ask for anyway.

Every stage works on all rows its predecessor kept. Null, empty and very
long texts, nulls in other columns, repeated rows, extra columns and empty
tables are handled as each operator's docstring says; a null or empty text
ends at stage 1, which rejects texts of fewer than ten words.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabflow.llm.bpe_codec import bpe_codec
from cabflow.llm.common import cut, delete, release, tables_of, written
from cabflow.llm.line_dedup import line_dedup
from cabflow.llm.minhash import near_duplicates
from cabflow.llm.mixing import mix_sources
from cabflow.llm.quality import quality_rules


#: Columns that operators read; all others ride along in one, so their names cannot clash.
READ = ("doc_id", "text", "source")
#: Columns of the last stage that give the order of the mix.
PLACE = ("mix_part", "mix_row")


#: Intermediate tables of the last stage over a folder, by application and folder.
_TABLES: dict[tuple[str, str], list[str]] = {}


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``run`` after deleting the tables of the stages before, of which ``docs`` reads none."""

    @functools.wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        earlier = _TABLES.pop(key, [])
        if earlier and not tables_of(docs) & set(earlier):
            delete(spark, earlier)
            earlier = []
        before = set(written())
        out = run(spark, docs, sf_dir)
        _TABLES[key] = earlier + [p for p in written() if p not in before]
        return out

    return stage


def _applied(operator: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` after ``operator``, with ``n_chars`` of the present text."""
    others = [c for c in docs.columns if c not in READ]
    carried = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried")] if others else []
    out = operator(docs.select(*[c for c in docs.columns if c in READ], *carried))

    def column(c: str) -> F.Column:
        if c in READ:
            return F.col(c)
        if c == "n_chars":
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col(f"carried.`{c}`").alias(c)

    return out.select(*map(column, docs.columns))


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _applied(lambda d: quality_rules(d, clean=True).where("kept"), docs)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _applied(lambda d: line_dedup(d).where("n_lines = 0 or n_removed < n_lines"), docs)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _applied(lambda d: near_duplicates(d).where("kept"), docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _applied(lambda d: mix_sources(d, ordered=True), docs)


def _with_places(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mix_part`` (number of the row's part file) and ``mix_row`` (place in it)."""
    docs = docs.drop(*PLACE)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
    try:
        return docs.select("*", part.alias("mix_part"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:  # not read from files: the order of the rows as they come
        each = F.monotonically_increasing_id()
        return docs.select("*", F.shiftright(each, 33).alias("mix_part"), each.bitwiseAND(F.lit((1 << 33) - 1)).alias("mix_row"))


@_stage
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return bpe_codec(_with_places(docs), tokenizer, results=("n_tokens", "ids", "decoded_sha256")).drop("text")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mix_sources", mixing_stage),
    ("bpe_codec", encoding_stage),
]

#: SQL cannot express the near-duplicate and encoding stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        result = cut(stage(spark, docs, sf_dir), f"stage-{at}")
        if at:
            release(docs)  # the result of the stage before
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
