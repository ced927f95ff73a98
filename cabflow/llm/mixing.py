"""Mixing sources to target weights by Pfair scheduling (operator 3).

Each source's documents, in a seeded random order, are laid end to end and
cut into blocks of about ``block_bytes``; a document belongs to the block in
which its first byte lies. Block ``k`` of a source with weight ``w`` is
released at ``floor(k / w)`` and due at ``ceil((k + 1) / w)``. Slots are
given to the released block with the earliest deadline (ties: by source).
As the weights add up to one, every block meets its deadline, so at every
slot each source is less than one block away from its target share.

Weights are rounded to multiples of ``1 / resolution`` (largest remainder,
one at least), so the schedule repeats every ``resolution`` slots: one
period, a table of exactly ``resolution`` rows, is scheduled once, and the
slot of any block follows by arithmetic. Sources are counted first; where
they are more than half the ``resolution``, it is twice their number. The mix ends where the source
richest in data for its weight has been used once; the others start again
(``copy`` 1, 2, ...), so every document is in the mix at least once.

A hot source is not brought together: its documents are dealt by hash into
buckets of about ``bucket_rows`` rows, each bucket adds up its own sizes and
the buckets' totals are added to them.

Defined cases: a null source is the source ``''``; a null or empty text
takes no bytes and lies in the block of the document before it; repeated
rows are scheduled once per row; more than ``most_sources`` sources (the
schedule's bound on the driver) are an error; a source that ``weights`` lacks, or a weight
that is not positive, is an error; columns named like a result are replaced;
an empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabflow.llm.common import cut, prepare

RESULTS = ("copy", "block", "slot", "release", "deadline")
BLOCK_BYTES, BUCKET_ROWS, RESOLUTION, EXPONENT = 64 << 10, 20_000, 10_000, 0.7
#: Sources that a schedule may have, and rows of it that are broadcast; a longer one is joined as Spark sees fit.
MOST_SOURCES, SMALL = 1_000_000, 10_000


def quotas(weights: dict[str, float], resolution: int) -> dict[str, int]:
    """Slots of each source in one period, by largest remainder, one at least."""
    if len(weights) > resolution:
        raise ValueError(f"{len(weights)} sources need a resolution of as many slots")
    total = math.fsum(weights.values())
    exact = {s: w / total * resolution for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    missing = resolution - sum(out.values())
    # Nearest to the next multiple first; if too many were raised to one, the largest give back.
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(0, missing)]:
        out[s] += 1
    names = sorted(out, reverse=True)
    largest = [(-out[s], i) for i, s in enumerate(names)]
    heapq.heapify(largest)
    for _ in range(max(0, -missing)):
        n, i = largest[0]
        out[names[i]] -= 1
        heapq.heapreplace(largest, (n + 1, i))
    return out


def period(quota: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, j, slot, release, deadline) of one period, earliest deadline first."""
    slots = sum(quota.values())
    release = lambda s, j: j * slots // quota[s]
    due = lambda s, j: -(-(j + 1) * slots // quota[s])
    waiting = [(0, s, 0) for s in quota]  # (release, source, j)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, j), s, j))
        deadline, s, j = heapq.heappop(ready)
        out.append((s, j, slot, release(s, j), deadline))
        if j + 1 < quota[s]:
            heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
    return out


def placed(rows: DataFrame, block_bytes: int, bucket_rows: int) -> DataFrame:
    """Rows (_source, _size, _order) with ``_block``, their block within the source."""
    n = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("_bucket", F.floor((F.col("_order").cast("double") / 2.0**64 + 0.5) * n))
    sizes = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_total"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_source", "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    place = F.floor((F.col("_before") + F.col("_offset")) / F.lit(block_bytes)).cast("long")
    return rows.join(offsets, ["_source", "_bucket"]).withColumn("_block", place)


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
    exponent: float = EXPONENT,
    resolution: int = RESOLUTION,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
    ordered: bool = False,
    most_sources: int = MOST_SOURCES,
) -> DataFrame:
    """The mix: ``docs`` (some several times) with ``copy``, ``block``, ``slot``, ``release``, ``deadline``.

    Reading it in the order of ``slot`` gives the mix; with ``ordered`` the
    rows are range-sorted that way, and by their place in the source within
    the block. ``weights`` names the share of each source in bytes; by default the share is that of its bytes
    to the power ``exponent``.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*[c for c in RESULTS if c not in (source, text, doc_id)])
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("_order"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = cut(rows, "mix-rows")
    places = cut(placed(rows.drop("_doc"), block_bytes, bucket_rows).select("_row", "_source", "_block"), "mix-places")
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("bytes")).join(places.groupBy("_source").agg((F.max("_block") + 1).alias("blocks")), "_source")
    totals = cut(totals, "mix-sources")
    n_sources = totals.count()
    if n_sources > most_sources:
        raise ValueError(f"{n_sources} sources, more than {most_sources}")
    resolution = max(resolution, 2 * n_sources)
    found = totals.collect()
    have = {r["_source"]: r["blocks"] for r in found}
    if weights is None:
        weights = {r["_source"]: float(max(r["bytes"], 1)) ** exponent for r in found}
    missing = [s for s in have if not weights.get(s, 0) > 0]
    if missing:
        raise ValueError(f"no positive weight for the sources {missing}")
    quota = quotas({s: weights[s] for s in have}, resolution) if have else {}
    slots = period(quota)
    slot_of = {(s, j): slot for s, j, slot, *_ in slots}
    end = max(((n - 1) // quota[s] * resolution + slot_of[s, (n - 1) % quota[s]] + 1 for s, n in have.items()), default=0)

    schedule = spark.createDataFrame(
        [(s, j, slot, r, d, quota[s], have[s], -(-(end // resolution + 1) * quota[s] // have[s])) for s, j, slot, r, d in slots],
        "_source string, _j long, _slot long, _release long, _due long, _quota long, _blocks long, _copies long",
    )
    sources = schedule.select("_source", "_quota", "_blocks", "_copies").distinct()
    # Both sides hold at most ``resolution`` rows.
    small = F.broadcast if resolution <= SMALL else (lambda df: df)
    copies = places.join(small(sources), "_source").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies"))))
    copies = copies.withColumn("block", F.col("copy") * F.col("_blocks") + F.col("_block"))
    copies = copies.withColumn("_j", F.col("block") % F.col("_quota")).withColumn("_base", F.floor(F.col("block") / F.col("_quota")).cast("long") * resolution)
    timed = copies.join(small(schedule.select("_source", "_j", "_slot", "_release", "_due")), ["_source", "_j"])
    timed = timed.select(
        "_row", "copy", "block",
        (F.col("_base") + F.col("_slot")).alias("slot"),
        (F.col("_base") + F.col("_release")).alias("release"),
        (F.col("_base") + F.col("_due")).alias("deadline"),
    ).where(F.col("slot") < end)
    out = rows.select("_row", "_order", "_doc").join(timed, "_row")
    if ordered:
        out = out.orderBy("slot", "_order", "_row")
    return out.select("_doc.*", *RESULTS)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of ``documents`` by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).drop("text")
