"""Silver without moving trips that have no copy; ranges and scan tasks that fit a task's memory."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cabflow.operators import layers
from cabflow.plans.check import plan_text
from cabflow.plans.queries import QUERIES
from cabflow.sources.layers import range_count, read_layer, write_layer

from conftest import SF_SMALL


def trips(spark, n=3_000):
    """Trips of which every 20th has a copy, some without taxi or month change, some rows equal in all keys."""
    start = F.lit(dt.datetime(2019, 3, 30, 8, 0)) + F.make_dt_interval(mins=F.col("id").cast("int"))
    rows = spark.range(n).withColumn("copy", F.explode(F.when(F.col("id") % 20 == 0, F.sequence(F.lit(0), F.col("id") % 3 + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    return rows.select(
        F.trunc(F.to_date(start), "month").alias("partition_month"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("T"), (F.col("id") % 11).cast("string"))).alias("taxi_id"),
        start.alias("trip_start_timestamp"),
        F.when(F.col("copy") != 1, F.col("copy").cast("double")).alias("trip_total"),
        F.lit(600).cast("long").alias("trip_seconds"),
        F.lit(2.0).alias("trip_miles"),
        F.when(F.col("id") % 3 != 0, F.format_string("k%d-%d", "id", "copy")).alias("unique_key"),
    ).repartition(6)


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_alone_and_deduped_marked_trips_are_the_deduped_trips(spark, monkeypatch, words):
    monkeypatch.setattr(layers, "MARK_WORDS", words)
    rows = trips(spark)
    alone, marked = layers.split_copies(rows, layers.copy_marks(rows))
    assert alone.columns == marked.columns == rows.columns
    together = alone.unionByName(layers.dedup(marked))
    assert sorted(map(repr, together.collect())) == sorted(map(repr, layers.dedup(rows).collect()))
    assert together.count() == 3_000
    assert marked.count() >= rows.count() - 3_000 + 150  # all copies and their originals
    if words > 1:
        assert alone.count() > 2_800


def test_trips_without_a_copy_are_not_shuffled(spark):
    rows = trips(spark).where("partition_month IS NOT NULL")
    alone, _ = layers.split_copies(rows, spark.createDataFrame([(0, 1)], "word long, bits long"))
    plan = plan_text(alone)
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_rows_in_place_are_written_beside_the_others(spark, scratch):
    path = f"{scratch}/in-place"
    rows = trips(spark)
    alone, marked = layers.split_copies(rows, layers.copy_marks(rows))
    write_layer(layers.dedup(marked), path, "trips_silver", in_place=alone)
    got = read_layer(spark, path, "trips_silver", lo="2013-01-01")
    assert sorted(map(repr, got.select(rows.columns).collect())) == sorted(map(repr, layers.dedup(rows).collect()))


def test_ranges_follow_the_bytes_of_large_tables(spark):
    """A range of 16 GB holds so much that a task can sort it in memory; the cores do not bound the ranges."""
    assert range_count(spark.range(2_000_000_000)) >= 16_000_000_000 // (64 << 20)


def test_trip_queries_read_in_pieces_that_fit_a_sort(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    QUERIES["trips_silver"](spark, SF_SMALL)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "24m"
