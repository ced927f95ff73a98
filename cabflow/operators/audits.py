"""Data-quality audits: completeness, payment words, anomalies, month status.

All audits are additive counts. From the base layer each audit groups by
its own key (year, month or payment word), so a task sends one partial row
per key it has seen. For the written path the counts also come from the
*audit profile*, one row per (trip day, payment word) with every counter
the audits need (trips, NULL counts, anomaly counts): base is scanned
once to write it, in tasks that each hold whole days of single months, and
the audits roll it up.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cabflow.functions import above, round_dec, safe_div
from cabflow.functions import trips as T
from cabflow.sources.layers import as_date
from cabflow.sources.schema import NULL_AUDIT_COLUMNS, TRIP_PARTITION

FIRST_MONTH = "2013-01-01"
MONTHLY_FIRST_MONTH = "2022-01-01"
PROFILE_TRIPS = "trips"


def anomaly_flags() -> dict[str, Column]:
    """The anomaly and quality conditions counted per year, in report order; comparisons with NaN are FALSE."""
    sec, km, total = F.col("trip_seconds"), F.col("trip_km"), F.col("trip_total")
    return {
        "ghost_trips": (F.coalesce(sec, F.lit(0)) == 0) & (F.coalesce(km, F.lit(0.0)) == 0),
        "end_before_start": F.col("trip_end_timestamp") < F.col("trip_start_timestamp"),
        "nonzero_trip_zero_pay": (sec > 0) & above(km, 0) & (total == 0),
        "impossible_speed": above("avg_speed_kmh", 130),
        "extreme_duration": F.col("duration_hr") > 6,
        "extreme_total": above(total, 500),
        "extreme_cost_min": above("dollars_per_min", 10) & (F.col("duration_min") > 1),
        "extreme_distance": above(km, 300),
        "total_mismatch": ~F.col("is_total_consistent"),
        "missing_geo": ~F.col("has_geo"),
        "airport_trips": F.col("is_airport_trip"),
        "payment_unknown": F.col("payment_category") == T.OTHER,
        "payment_no_revenue": F.col("payment_category") == T.NO_CHARGE,
    }


def is_profile(df: DataFrame) -> bool:
    return "trip_date" in df.columns and PROFILE_TRIPS in df.columns


def counters() -> dict[str, Column]:
    """Every count the audits need, as aggregates over the enriched view."""
    nulls = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in NULL_AUDIT_COLUMNS}
    flags = {name: F.count_if(condition) for name, condition in anomaly_flags().items()}
    return {PROFILE_TRIPS: F.count(F.lit(1)), **nulls, **flags}


def _enriched(base: DataFrame) -> DataFrame:
    from cabflow.operators.layers import enrich  # layers imports nothing from here

    return base if "trip_km" in base.columns else enrich(base)


def audit_profile(base: DataFrame) -> DataFrame:
    """(trip_date, payment_type) -> every counter, from the base layer or the enriched view."""
    day = F.to_date("trip_start_timestamp").alias("trip_date")
    return _enriched(base).groupBy(day, F.col("payment_type")).agg(*[c.alias(name) for name, c in counters().items()])


def _counted(source: DataFrame, lo: str | _dt.date) -> tuple[DataFrame, Column, Callable[[str], Column]]:
    """Rows from month ``lo`` on, their trip day, and the aggregate of each counter."""
    bound = F.lit(as_date(lo))
    if is_profile(source):
        return source.filter(F.trunc("trip_date", "month") >= bound), F.col("trip_date"), F.sum
    # From the base layer: bound the partition column, so months are pruned.
    rows = _enriched(source.filter(F.col(TRIP_PARTITION) >= bound))
    return rows, F.to_date("trip_start_timestamp"), counters().__getitem__


def audit_nulls(
    source: DataFrame,
    by: str = "year",
    lo: str | _dt.date | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Rows and NULL percentage (2 d.p.) of each audited column per year.

    ``by="month"`` groups by year and month, adds the number of distinct
    trip days, and defaults to the months from 2022 on. ``source`` is the
    base layer or its audit profile.
    """
    if by not in ("year", "month"):
        raise ValueError("by must be 'year' or 'month'")
    monthly = by == "month"
    lo = lo or (MONTHLY_FIRST_MONTH if monthly else FIRST_MONTH)
    columns = columns or NULL_AUDIT_COLUMNS
    rows, day, count = _counted(source, lo)
    keys = [F.year(day).alias("year")] + ([F.month(day).alias("month")] if monthly else [])
    counts = [count(PROFILE_TRIPS).alias("total_rows")]
    counts += [count(f"null_{c}").alias(f"null_{c}") for c in columns]
    if monthly:
        counts.append(F.count_distinct(day).alias("distinct_days"))
    agg = rows.groupBy(*keys).agg(*counts)
    key_names = ["year", "month"] if monthly else ["year"]
    out = key_names + (["distinct_days"] if monthly else []) + ["total_rows"]
    pcts = [
        round_dec(F.col(f"null_{c}") / F.col("total_rows") * 100, 2).alias(f"{c}_null_pct") for c in columns
    ]
    return agg.select(*out, *pcts).orderBy(*key_names)


def audit_payment_types(source: DataFrame, lo: str | _dt.date = FIRST_MONTH) -> DataFrame:
    """Each raw payment word: occurrences and first/last month seen."""
    rows, day, count = _counted(source, lo)
    month = F.trunc(day, "month")
    return (
        rows.groupBy("payment_type")
        .agg(
            count(PROFILE_TRIPS).alias("total_occurrences"),
            F.min(month).alias("first_seen"),
            F.max(month).alias("last_seen"),
        )
        .orderBy(F.desc("total_occurrences"))
    )


def audit_anomalies(source: DataFrame, lo: str | _dt.date = FIRST_MONTH) -> DataFrame:
    """Per year: rows, 13 anomaly/quality counts and three percentages (3 d.p.)."""
    names = list(anomaly_flags())
    rows, day, count = _counted(source, lo)
    agg = rows.groupBy(F.year(day).alias("trip_year")).agg(
        count(PROFILE_TRIPS).alias("total_rows"), *[count(n).alias(n) for n in names]
    )
    pct = lambda n: round_dec(safe_div(F.col(n), F.col("total_rows")) * 100, 3)
    return agg.select(
        "trip_year",
        "total_rows",
        *names,
        pct("ghost_trips").alias("ghost_pct"),
        pct("impossible_speed").alias("speed_pct"),
        pct("total_mismatch").alias("mismatch_pct"),
    ).orderBy(F.desc("trip_year"))


# A month with at most this many distinct trip days is BROKEN; one with less
# than LOW_SHARE of the rows of the fullest month is LOW. A share keeps the
# labels the same whatever the volume; any share between about a fifth and
# three quarters gives the source's hand-made labels of its 2022-2023 months.
BROKEN_MAX_DAYS = 1
LOW_SHARE = 0.4


def audit_month_status(monthly_audit: DataFrame, low_share: float = LOW_SHARE, broken_max_days: int = BROKEN_MAX_DAYS) -> DataFrame:
    """Label each month of ``audit_nulls(by="month")`` OK / LOW / BROKEN."""
    # One row per month: the window without keys holds a few hundred rows at most.
    fullest = F.max("total_rows").over(Window.partitionBy())
    status = (
        F.when(F.col("distinct_days") <= broken_max_days, F.lit("BROKEN"))
        .when(F.col("total_rows") < low_share * fullest, F.lit("LOW"))
        .otherwise(F.lit("OK"))
    )
    return monthly_audit.select(
        "year",
        "month",
        "distinct_days",
        "total_rows",
        "trip_end_timestamp_null_pct",
        "trip_seconds_null_pct",
        "trip_miles_null_pct",
        "pickup_census_tract_null_pct",
        "dropoff_census_tract_null_pct",
        "pickup_community_area_null_pct",
        "dropoff_community_area_null_pct",
        status.alias("status"),
    ).orderBy("year", "month")
