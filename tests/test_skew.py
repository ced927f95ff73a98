"""Hot keys: a group holding most rows is cut down before it is shuffled."""

import datetime as dt

from pyspark.sql import functions as F

from cabflow.operators import layers, marts
from cabflow.plans.check import shuffle_records

HOT_ROWS, OTHER_ROWS, TASKS = 30_000, 2_000, 8


def test_hot_duplicate_group_is_cut_before_the_dedup_shuffle(spark):
    start = dt.datetime(2019, 3, 1, 8, 0)
    rows = spark.range(HOT_ROWS + OTHER_ROWS).select(
        F.format_string("k%06d", "id").alias("unique_key"),
        # 30,000 copies of one trip (one taxi, one start), 2,000 distinct trips
        F.when(F.col("id") < HOT_ROWS, F.lit("HOT")).otherwise(F.concat(F.lit("T"), F.col("id").cast("string"))).alias("taxi_id"),
        F.lit(start).alias("trip_start_timestamp"),
        (F.col("id") % 97).cast("double").alias("trip_total"),
        F.lit(600).cast("long").alias("trip_seconds"),
        F.lit(2.0).alias("trip_miles"),
    ).repartition(TASKS)
    deduped = layers.dedup(rows)
    kept = deduped.collect()
    assert len(kept) == OTHER_ROWS + 1
    hot = [r for r in kept if r.taxi_id == "HOT"][0]
    assert hot.trip_total == 96.0 and hot.unique_key == "k000096"
    (partitioning, written), = [s for s in shuffle_records(deduped) if "taxi_id" in s[0]]
    # at most one row per key and map task crosses the network
    assert written <= OTHER_ROWS + TASKS


def test_hot_mart_group_is_combined_map_side(spark):
    start = dt.datetime(2019, 3, 1, 8, 0)
    hours = F.when(F.col("id") < HOT_ROWS - 10, 0).otherwise(F.col("id") % 5).cast("int")
    silver = spark.range(HOT_ROWS).select(
        # one hour holds almost everything
        (F.lit(start) + F.make_dt_interval(hours=hours)).alias("trip_start_timestamp"),
        F.lit(10.0).alias("trip_total"),
        F.lit(1.0).alias("tips"),
        F.lit(3.0).alias("trip_km"),
        F.lit(12.0).alias("duration_min"),
    ).repartition(TASKS)
    silver = silver.withColumn("partition_month", F.trunc(F.to_date("trip_start_timestamp"), "month"))
    mart = marts.mart_time_analysis(silver)
    rows = mart.collect()
    assert sum(r.trip_count for r in rows) == HOT_ROWS
    (partitioning, written), = [s for s in shuffle_records(mart) if s[0].startswith("hashpartitioning")]
    # one partial row per group and map task, not one row per trip
    assert written <= len(rows) * TASKS
