r"""Line dedup by a suffix array over line sequences (operator 5, DataFrame functions only).

Each document is the sequence of its lines that hold a word. All suffixes of
all sequences are sorted by distributed prefix doubling: suffixes get the
rank of their first line; a round joins each suffix's rank with the rank of
the suffix some lines further and sorts the pairs, which ranks the suffixes
by up to twice as many lines. A suffix whose prefix is unique cannot start a
repeated run and leaves the sort. Equal ranks by ``d`` lines are the
intervals of the suffix array whose longest common prefix has ``d`` lines or
more; the first suffix of an interval in document order is the original, at
the others a run of ``d`` lines or more begins that stands earlier as well.

Deleted are all maximal such runs of ``min_lines`` lines or more, or of
``min_words`` words or more, so that one line goes if it is a long passage.
The sort ends at ``min_lines`` lines: of a longer run each line but the last
``min_lines - 1`` starts one of at least ``min_lines`` lines itself, so the
runs found up to that depth cover the maximal ones to their end. How many
lines from a place on have ``min_words`` words (``need``) follows from the
lines, so all suffixes of an interval of that depth agree in it. Runs are
judged on the input, not on what is left.

Ranks are made without bringing the keys together: distinct keys, already
counted in the tasks, are range-sorted, each range adds up its own counts,
and the ranges' totals (one row each) are added to them. A line or run that
a third of all documents share is one key. Every round is written to the
shared folder.

Document order is (doc_id, row), null ids last; of repeated rows the first
stays. Words are ``[^\x20\x09-\x0D]+``; a line is compared as it stands.
Defined cases: null, empty and blank texts have no lines and stay as they
are; a document without copies keeps its text unchanged; one with copies
keeps its other lines that hold a word, joined by newlines (an empty text if
none is left); columns named like a result are replaced, one named
``row`` is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabflow.llm.common import cut, prepare, release

MIN_LINES, MIN_WORDS = 3, 50
RESULTS = ("n_lines", "n_removed", "runs")
_WORD = r"[^\x20\x09-\x0D]"


def worded_lines(text: str) -> F.Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1), lambda line: line.rlike(_WORD))


def ranked(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct ``keys`` with ``n`` suffixes each -> the first place ``lb`` of each in the sorted order."""
    order = groups.orderBy(*keys).withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    order = cut(order, name)
    totals = order.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("n").over(within), F.lit(0))
    return order.withColumn("place", place).join(offsets, "part").select(*keys, (F.col("place") + F.col("offset")).alias("lb"))


def repeated(suffixes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Suffixes (row, i, need, keys) whose keys occur twice or more, with their rank ``lb``."""
    groups = suffixes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return cut(suffixes.join(ranked(groups, keys, f"{name}-order"), keys).select("row", "i", "need", "lb"), name)


def suffix_intervals(lines: DataFrame, depth: int) -> dict[int, DataFrame]:
    """By number of lines 1 .. ``depth``: (row, i, need, lb) of suffixes that share so many with another, by interval."""
    found = {1: repeated(lines, ["h1", "h2"], "suffixes-1")}
    for known in range(2, depth + 1):
        half = 1 << (known - 1).bit_length() - 1  # the greatest power of two below
        ahead = found[half].select("row", (F.col("i") - (known - half)).alias("i"), F.col("lb").alias("r2"))
        pairs = found[half].withColumnRenamed("lb", "r1").join(ahead, ["row", "i"])
        found[known] = repeated(pairs, ["r1", "r2"], f"suffixes-{known}")
    return found


def repeated_runs(lines: DataFrame, min_lines: int) -> DataFrame:
    """(row, runs): maximal runs of lines that are later copies, as (start, lines).

    ``need`` of a line is the number of lines from it on that have enough words, at most ``min_lines``.
    """
    intervals = suffix_intervals(lines.select("row", "i", "need", "h1", "h2"), min_lines)
    place = F.struct("row", "i")  # rows are numbered in document order
    copies = []
    for depth, suffixes in intervals.items():
        long_enough = suffixes.where(F.col("need") <= depth)
        originals = long_enough.groupBy("lb").agg(F.min(place).alias("first"))
        later = long_enough.join(originals, "lb").where(place != F.col("first"))
        copies.append(later.select("row", "i", (F.col("i") + depth).alias("end")))
    along = Window.partitionBy("row").orderBy("i", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("i") > reached).cast("int"), F.lit(1))
    run = reduce(DataFrame.unionAll, copies).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    spans = run.groupBy("row", "run").agg(F.min("i").alias("start"), (F.max("end") - F.min("i")).alias("lines"))
    runs = cut(spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "lines"))).alias("runs")), "runs")
    for suffixes in intervals.values():
        release(suffixes)
    return runs


def lines_needed(min_lines: int, min_words: int) -> F.Column:
    """Lines (row, i, words) -> how many from each on have ``min_words`` words, at most ``min_lines``."""
    need = F.lit(min_lines)
    for n in range(min_lines - 1, 0, -1):
        span = Window.partitionBy("row").orderBy("i").rowsBetween(0, n - 1)
        need = F.when(F.sum("words").over(span) >= min_words, F.lit(n)).otherwise(need)
    return need.alias("need")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs of ``min_lines`` lines, or ``min_words`` words, or more deleted from ``text``.

    Adds ``n_lines`` (with a word, before), ``n_removed`` and ``runs``
    (start among those lines, number of lines).
    """
    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in (*RESULTS, "row") if c not in (text, doc_id)])
    # Rows numbered in document order: sorted ranges, numbered within each.
    rows = cut(docs.orderBy(F.col(doc_id).asc_nulls_last(), F.xxhash64(text)).withColumn("row", F.monotonically_increasing_id()), "rows")
    lines = rows.select("row", F.posexplode(worded_lines(text)).alias("i", "line"))
    lines = lines.select("row", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.size(F.regexp_extract_all("line", F.lit(_WORD + "+"), F.lit(0))).alias("words"))
    lines = cut(lines.select("row", "i", "h1", "h2", lines_needed(min_lines, min_words)), "lines")
    runs = repeated_runs(lines, min_lines)
    release(lines)
    out = rows.join(runs, "row", "left").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "runs", worded_lines(text).alias("lines"))
    inside = lambda i: F.exists("runs", lambda r: (i >= r["start"]) & (i < r["start"] + r["lines"]))
    kept = F.array_join(F.filter("lines", lambda _, i: ~inside(i)), "\n")
    same = F.col(f"doc.`{text}`")
    return out.select(
        *[F.when(F.col("runs").isNull(), same).otherwise(kept).alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["lines"]), F.lit(0)).cast("long").alias("n_removed"),
        "runs",
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs from every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.size(F.coalesce("runs", F.array())).cast("long").alias("n_runs"), "text")


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS rid, doc_id, text,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), line AS (
  SELECT rid, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM docs
), win AS (
  SELECT rid, i, l, lead(l, 1) OVER d AS l1, lead(l, 2) OVER d AS l2,
         length(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w, lead(w, 1, 0) OVER d AS w1
  FROM line WINDOW d AS (PARTITION BY rid ORDER BY i)
), later AS (
  SELECT rid, i, 1 AS lines FROM win WHERE w >= 50
  QUALIFY row_number() OVER (PARTITION BY l ORDER BY rid, i) > 1
  UNION ALL
  SELECT rid, i, 2 FROM win WHERE l1 IS NOT NULL AND w + w1 >= 50
  QUALIFY row_number() OVER (PARTITION BY l, l1 ORDER BY rid, i) > 1
  UNION ALL
  SELECT rid, i, 3 FROM win WHERE l2 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l, l1, l2 ORDER BY rid, i) > 1
), gone AS (
  SELECT DISTINCT rid, i + k AS i FROM later, (SELECT unnest([0, 1, 2]) AS k) WHERE k < lines
), left_over AS (
  SELECT rid, string_agg(l, chr(10) ORDER BY i) AS kept FROM line ANTI JOIN gone USING (rid, i) GROUP BY rid
), removed AS (
  SELECT rid, count(*) AS n_removed,
         count(*) FILTER (WHERE before IS NULL OR before < i - 1) AS n_runs
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM gone) GROUP BY rid
)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       CASE WHEN n_removed IS NULL THEN text ELSE coalesce(kept, '') END AS text
FROM docs LEFT JOIN removed USING (rid) LEFT JOIN left_over USING (rid)
"""
