"""Embedding near-dedup by random-hyperplane sign hashing (operator 1).

The signs of a vector's products with ``bits`` random hyperplanes are its
bucket in one of several tables. ``bits`` follows the number of vectors so
that a bucket holds about ``bucket_rows``, and the number of tables follows
from ``bits`` so that a pair at the threshold meets in one table at least
with probability ``recall``. In a bucket the cosines of all its pairs are
computed in double precision as matrix products; a pair is counted in the
first table where it meets, which the vectors' other bucket numbers tell, so
degrees add up without a list of pairs. For components each task passes on
one link per vector (to the smallest vector of its part of the bucket);
``components`` joins them.

Equal vectors are one node with a count, so a group of copies costs one row.
A bucket larger than ``bucket_rows`` is dealt into parts and its pairs of
parts go to different tasks; no task ever holds more than two parts.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are components of their own; vectors of
different lengths link with nothing; a row whose id is null counts as a
vector, its component is the smallest id reachable (null if none); repeated
rows are vectors each; an empty table gives an empty result; columns named
like a result are replaced, one named
``row`` is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabflow.llm.common import cut, prepare
from cabflow.llm.components import components, local_components

THRESHOLD, RECALL, BUCKET_ROWS, LEAST_BITS = 0.9, 0.999, 1024, 4
RESULTS = ("n_links", "component_id", "kept")


def plan_tables(n: int, threshold: float, recall: float, bucket_rows: int) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = min(30, max(LEAST_BITS, math.ceil(math.log2(max(1, n) / bucket_rows))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _vectors(column: pa.Array) -> np.ndarray:
    """A batch's equally long vectors as rows of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _hash(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("dim"))
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                part = batch.take(pa.array(at))
                sign = _vectors(part.column("vector")) @ hyperplanes(int(dim), bits, tables, seed) >= 0
                codes = sign.reshape(len(at), tables, bits) @ (1 << np.arange(bits))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(codes.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, listed], names=[*batch.schema.names, "codes"])

    return run


def _link(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """One pair of parts of a bucket: per vector its degree and its smallest connected vector."""
        table = table.combine_chunks()
        order = np.argsort(np.asarray(table.column("node")), kind="stable")
        table = table.take(pa.array(order))
        node, copies = np.asarray(table.column("node")), np.asarray(table.column("copies"))
        place, part = np.asarray(table.column("place"))[0], np.asarray(table.column("part"))
        first, second = np.asarray(table.column("first"))[0], np.asarray(table.column("second"))[0]
        unit = _vectors(table.column("vector").combine_chunks() if isinstance(table.column("vector"), pa.ChunkedArray) else table.column("vector"))
        unit = unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        codes_column = table.column("codes").combine_chunks()
        codes = np.asarray(codes_column.flatten()).reshape(len(node), -1)
        degree = np.zeros(len(node), np.int64)
        left = np.flatnonzero(part == first)
        right = left if first == second else np.flatnonzero(part == second)
        ends_a, ends_b = [], []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            i, j = np.nonzero(unit[rows] @ unit[right].T >= threshold)
            i, j = rows[i], right[j]
            keep = i < j if first == second else i != j
            i, j = i[keep], j[keep]
            ends_a.append(i)
            ends_b.append(j)
            fresh = ~(codes[i, :place] == codes[j, :place]).any(axis=1)  # they met in no earlier table
            np.add.at(degree, i[fresh], copies[j[fresh]])
            np.add.at(degree, j[fresh], copies[i[fresh]])
        label = local_components(len(node), np.concatenate(ends_a), np.concatenate(ends_b)) if ends_a else np.arange(len(node))
        used = np.flatnonzero((degree > 0) | (label != np.arange(len(node))))
        return pa.table({"node": pa.array(node[used], pa.int64()), "degree": pa.array(degree[used], pa.int64()), "low": pa.array(node[label[used]], pa.int64())})

    return run


def embedding_dedup(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 0,
) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``."""
    prepare(vectors.sparkSession)
    vectors = vectors.drop(*[c for c in (*RESULTS, "row") if c not in (vec_id, embedding)])
    rows = cut(vectors.withColumn("row", F.monotonically_increasing_id()), "vector-rows")
    doubles = F.col(embedding).cast("array<double>")
    usable = (
        (F.size(doubles) > 0)
        & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(doubles, lambda x: x != 0)
    )
    # Scaled by the largest component: no overflow or underflow, the cosine stays.
    usable_rows = rows.where(usable).select("row", doubles.alias("vector"))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = usable_rows.withColumn("most", largest).select("row", F.transform("vector", lambda x: x / F.col("most") + F.lit(0.0)).alias("vector"))
    keyed = scaled.withColumn("key", F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")))
    members = cut(keyed.select("row", "key", "vector"), "vector-keys")
    nodes = members.groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = cut(nodes.withColumn("dim", F.size("vector")), "vector-nodes")

    bits, tables = plan_tables(nodes.count(), threshold, recall, bucket_rows)
    schema = "key string, node long, copies long, vector array<double>, dim int, codes array<long>"
    hashed = cut(nodes.mapInArrow(_hash(bits, tables, seed), schema).drop("key"), "vector-codes")
    placed = hashed.select("*", F.posexplode("codes").alias("place", "code"))
    sizes = hashed.select("dim", F.posexplode("codes").alias("place", "code")).groupBy("dim", "place", "code").agg(F.count("*").alias("size"))
    sizes = sizes.where("size > 1").withColumn("parts", F.ceil(F.col("size") / F.lit(bucket_rows)).cast("int"))
    parted = placed.join(sizes.drop("size"), ["dim", "place", "code"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = other.withColumn("first", F.least("part", "other")).withColumn("second", F.greatest("part", "other"))
    cells = cells.select("dim", "place", "code", "first", "second", "part", "node", "copies", "vector", "codes")
    found = cells.groupBy("dim", "place", "code", "first", "second").applyInArrow(_link(threshold), "node long, degree long, low long")
    found = cut(found, "vector-links")

    degree = found.groupBy("node").agg(F.sum("degree").alias("degree"))
    label = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    known = (
        members.select("row", "key")
        .join(nodes.select("key", "node", "copies"), "key")
        .join(degree, "node", "left")
        .join(label, "node", "left")
        .select("row", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    labelled = cut(rows.select("row", F.col(vec_id).alias("id")).join(known, "row", "left").withColumn("component", F.coalesce("component", "row")), "vector-components")
    smallest = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    out = labelled.join(smallest, "component").select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    out = rows.join(out, "row").withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(False)))
    return out.select(*vectors.columns, *RESULTS)


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_dedup(vectors).drop("embedding")


#: All pairs, and all links followed; the hashing finds a pair at the threshold with probability RECALL.
OP1_SQL = """
WITH RECURSIVE vec AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e FROM vec
  WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(e, lambda x: x <> 0))
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM vec
  UNION
  SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other
), component AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN degree USING (vec_id)
"""
