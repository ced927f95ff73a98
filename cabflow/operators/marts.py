"""Data marts: additive monthly pre-aggregates of the silver layer.

Each mart is one hash aggregation with map-side partial aggregation, so a
hot group (one firm, one hour, one pair of areas) is combined inside each
map task before anything is shuffled; only one partial row per group and
task crosses the network. The month key is the partition column itself, so
the month bound prunes whole partitions of a written silver layer.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, functions as F

from cabflow.functions import above, exact_sum
from cabflow.functions import trips as T
from cabflow.sources.layers import as_date
from cabflow.sources.schema import TRIP_PARTITION



def _month() -> "F.Column":
    return F.col(TRIP_PARTITION)


def _zero(c: str) -> "F.Column":
    return F.coalesce(F.col(c), F.lit(0.0))


def mart_company_performance(
    silver: DataFrame, lo: str | _dt.date = "2017-01-01", hi: str | _dt.date = "2021-12-01"
) -> DataFrame:
    """Month x firm x payment category x airport flag; 7 measures.

    ``active_taxis`` is a distinct count: it does not add up over months.
    """
    return (
        silver.filter(_month().between(F.lit(as_date(lo)), F.lit(as_date(hi))))
        .groupBy(
            _month().alias("month_start"),
            F.col("company_clean"),
            F.coalesce(F.col("payment_category"), F.lit(T.OTHER)).alias("payment_category"),
            F.coalesce(F.col("is_airport_trip"), F.lit(False)).alias("is_airport_trip"),
        )
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            F.count_distinct("taxi_id").alias("active_taxis"),
            exact_sum(_zero("trip_total")).alias("total_revenue"),
            exact_sum(_zero("fare")).alias("total_fare"),
            exact_sum(_zero("tips")).alias("total_tips"),
            exact_sum(_zero("trip_km")).alias("total_trip_km"),
            exact_sum(_zero("duration_min")).alias("total_duration_min"),
        )
    )


def mart_time_analysis(
    silver: DataFrame, lo: str | _dt.date = "2013-01-01", before: str | _dt.date = "2022-01-01"
) -> DataFrame:
    """Month x week day (1 = Sunday) x hour; 6 measures incl. tipped trips."""
    start = F.col("trip_start_timestamp")
    return (
        silver.filter((_month() >= F.lit(as_date(lo))) & (_month() < F.lit(as_date(before))))
        .groupBy(
            _month().alias("month_start"),
            F.dayofweek(start).alias("day_of_week"),
            F.hour(start).alias("hour_of_day"),
        )
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            F.count_if(above(_zero("tips"), 0)).alias("tipped_trip_count"),
            exact_sum(_zero("trip_total")).alias("total_revenue"),
            exact_sum(_zero("tips")).alias("total_tips"),
            exact_sum(_zero("trip_km")).alias("total_trip_km"),
            exact_sum(_zero("duration_min")).alias("total_duration_min"),
        )
    )


def mart_geo_flows(
    silver: DataFrame, lo: str | _dt.date = "2017-01-01", hi: str | _dt.date = "2021-12-01"
) -> DataFrame:
    """Month x pickup area x dropoff area x airport flag; 5 measures.

    Sums skip NULLs here (a group of NULL totals sums to NULL).
    """
    return (
        silver.filter(
            _month().between(F.lit(as_date(lo)), F.lit(as_date(hi)))
            & F.col("pickup_community_area").isNotNull()
            & F.col("dropoff_community_area").isNotNull()
        )
        .groupBy(
            _month().alias("month_start"),
            F.col("pickup_community_area"),
            F.col("dropoff_community_area"),
            F.col("is_airport_trip"),
        )
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            exact_sum("trip_total").alias("total_revenue"),
            exact_sum("trip_km").alias("total_trip_km"),
            exact_sum("duration_min").alias("total_duration_min"),
            exact_sum("tips").alias("total_tips"),
        )
    )
