"""Connected components of a link table by alternating large-star and small-star steps.

In a round, each task first turns edges of its own, a bounded number at a time,
into stars: a dense graph is nearly done then. Each step takes the smallest
neighbour of every node with a partial aggregate and joins it back, so a node
with very many links is a skewed join key that adaptive execution splits, never
a list in one task. The rounds end once all edges are stars around smallest
nodes; nothing but one number a round (nodes that stand otherwise) comes to the
driver. Every round's edges are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabflow.llm.common import cut, gathered, release

#: Edges (8 bytes an end) that a task joins at a time.
JOINED_BYTES = 4 << 20


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected with each of ``n`` places by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task as stars around the smallest nodes: never more edges, and the same components."""
    for table in gathered(batches, "u", JOINED_BYTES):
        node, end = np.unique(np.concatenate([np.asarray(table.column(c)) for c in "uv"]), return_inverse=True)
        low = local_components(len(node), end[: table.num_rows], end[table.num_rows :])
        leaf = np.flatnonzero(low != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[leaf], pa.int64()), pa.array(node[low[leaf]], pa.int64())], names=["u", "v"])



def _directed(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or only edges to greater ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    other = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return other.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node."""
    edges = cut(_directed(links), name)
    while not _settled(edges):
        joined = cut(edges.mapInArrow(_stars, "u long, v long"), f"{name}-stars")
        release(edges)
        large = cut(_directed(_large_star(joined)), f"{name}-large")
        release(joined)
        edges = cut(_directed(_small_star(large)), f"{name}-small")
        release(large)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
