"""Schemas of the raw trips and of the derived layers."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Raw trip record (the public taxi-trip table; the columns the analysis
# names). Timestamps are UTC instants; the test adapter produces them as
# TIMESTAMP_NTZ, which every function here accepts alike.
RAW_FIELDS = [
    ("unique_key", StringType()),
    ("taxi_id", StringType()),
    ("trip_start_timestamp", TimestampType()),
    ("trip_end_timestamp", TimestampType()),
    ("trip_seconds", LongType()),
    ("trip_miles", DoubleType()),
    ("pickup_census_tract", LongType()),
    ("dropoff_census_tract", LongType()),
    ("pickup_community_area", LongType()),
    ("dropoff_community_area", LongType()),
    ("fare", DoubleType()),
    ("tips", DoubleType()),
    ("tolls", DoubleType()),
    ("extras", DoubleType()),
    ("trip_total", DoubleType()),
    ("payment_type", StringType()),
    ("company", StringType()),
    ("pickup_latitude", DoubleType()),
    ("pickup_longitude", DoubleType()),
    ("pickup_location", StringType()),
    ("dropoff_latitude", DoubleType()),
    ("dropoff_longitude", DoubleType()),
    ("dropoff_location", StringType()),
]
RAW_SCHEMA = StructType([StructField(name, dtype, True) for name, dtype in RAW_FIELDS])
RAW_COLUMNS = [name for name, _ in RAW_FIELDS]

# Columns whose NULL share the completeness audit reports, in report order.
NULL_AUDIT_COLUMNS = [
    "trip_end_timestamp",
    "trip_seconds",
    "trip_miles",
    "pickup_census_tract",
    "dropoff_census_tract",
    "pickup_community_area",
    "dropoff_community_area",
    "fare",
    "tips",
    "tolls",
    "extras",
    "trip_total",
    "payment_type",
    "company",
    "pickup_location",
    "dropoff_location",
]

# Columns the enriched layer adds, in order.
ENRICHED_COLUMNS = [
    "company_clean",
    "trip_km",
    "duration_min",
    "duration_hr",
    "avg_speed_kmh",
    "dollars_per_km",
    "dollars_per_min",
    "component_sum",
    "component_gap",
    "has_geo",
    "is_airport_trip",
    "is_total_consistent",
    "payment_category",
]

# Partition column of the trip layers and of the marts.
TRIP_PARTITION = "partition_month"
MART_PARTITION = "month_start"
# The audit profile is days x payment words (~50k rows even for a decade of
# full data): yearly partitions, not monthly ones, keep its files sensible.
PROFILE_PARTITION = "trip_year"
PARTITION_COLUMNS = {"audit_profile": PROFILE_PARTITION}

# Clustering keys used to sort rows inside each written month (min/max
# statistics of Parquet row groups then prune on them).
CLUSTER_KEYS = {
    "trips_base": ["company", "taxi_id", "pickup_community_area", "payment_type"],
    "trips_silver": ["company_clean", "taxi_id", "payment_category", "pickup_community_area"],
    "mart_company_performance": ["company_clean", "payment_category", "is_airport_trip"],
    "mart_time_analysis": ["day_of_week", "hour_of_day"],
    "mart_geo_flows": ["pickup_community_area", "dropoff_community_area", "is_airport_trip"],
}

# Layers large enough that a month may need several files: laid out by ranges of the keys.
RANGED_LAYERS = ("trips_base", "trips_silver")

# Layers whose reads must name a month range (the geo mart may be scanned whole).
GUARDED_LAYERS = {
    "trips_base": True,
    "audit_profile": True,
    "trips_silver": True,
    "trips_set_aside": False,
    "mart_company_performance": True,
    "mart_time_analysis": True,
    "mart_geo_flows": False,
}
