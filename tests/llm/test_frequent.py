"""The most frequent rows without a sort of all, and blocks that hold no hot key."""

import random

import pytest
from pyspark.sql import functions as F

from cabflow.llm import common


@pytest.mark.parametrize("size", [0, 1, 7, 40, 300, 5_000])
def test_most_frequent_equals_the_sorted_list(spark, size):
    rng = random.Random(3)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), min(int(1 / rng.random() ** 2), 1 << 40)) for _ in range(1_500)]
    rows += [(rng.randrange(-(1 << 63), 1 << 63), n) for n in (1, 2, 5_000, 5_001, 5_002) for _ in range(300)]
    counts = spark.createDataFrame(rows, "word long, n long").repartition(7)
    found = [(r["word"], r["n"]) for r in common.most_frequent(counts, size, "word")]
    assert found == sorted(rows, key=lambda r: (-r[1], r[0]))[:size]


def test_most_frequent_of_nothing(spark):
    assert common.most_frequent(spark.createDataFrame([], "word long, n long"), 5, "word") == []


def test_most_frequent_sends_about_what_it_returns(spark, monkeypatch):
    """Of 20,000 ties over 50 partitions, twice ``size`` rows at most reach the driver."""
    sent = []
    counts = spark.range(20_000, numPartitions=50).select(F.xxhash64("id").alias("word"), F.lit(3).cast("long").alias("n"))
    collect = type(counts).collect
    monkeypatch.setattr(type(counts), "collect", lambda df: sent.append(collect(df)) or sent[-1])
    assert len(common.most_frequent(counts, 100, "word")) == 100
    assert len(sent[-1]) <= 200 and all(len(x) <= 4_096 for x in sent)


@pytest.mark.parametrize("ids", ["null", "one"])
def test_rows_of_one_id_spread_over_blocks(spark, ids):
    doc_id = F.lit(None).cast("long") if ids == "null" else F.lit(4).cast("long")
    rows = spark.range(2_000).select(doc_id.alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sizes = [r["count"] for r in common.with_blocks(rows, "doc_id", "text", 16).groupBy("block").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 250
