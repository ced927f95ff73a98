"""Reports on the marts (small result sets).

Marts are pre-aggregated, so every report is a re-aggregation of a few
thousand rows per month. Shares use a scalar subquery for the market
total (computed once, inlined as a value — no join) or a window over a
low-cardinality key (the year); top-k uses a ranked window that plans as
a WindowGroupLimit, so only k rows per key and task are shuffled.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window, functions as F

from cabflow.functions import exact_sum, round_dec, safe_div
from cabflow.functions import trips as T
from cabflow.sources.layers import as_date

MIN_TRIPS = 1000


def _month():
    return F.col("month_start")


def _between(lo, hi):
    return _month().between(F.lit(as_date(lo)), F.lit(as_date(hi)))


def report_company_tips(
    company_mart: DataFrame,
    min_trips: int = MIN_TRIPS,
    lo: str | _dt.date = "2017-01-01",
    hi: str | _dt.date = "2021-12-01",
) -> DataFrame:
    """Per firm with at least ``min_trips`` trips: average ticket and tip ratios (unordered)."""
    agg = (
        company_mart.filter(_between(lo, hi))
        .groupBy("company_clean")
        .agg(
            F.sum("trip_count").alias("trips"),
            exact_sum("total_revenue").alias("revenue"),
            exact_sum("total_tips").alias("tips"),
            exact_sum("total_trip_km").alias("km"),
            exact_sum("total_duration_min").alias("minutes"),
        )
    )
    return agg.filter(F.col("trips") >= min_trips).select(
        "company_clean",
        round_dec(safe_div("revenue", "trips"), 2).alias("avg_trip_total"),
        round_dec(safe_div("tips", "km"), 4).alias("tips_per_km"),
        round_dec(safe_div("tips", "minutes"), 4).alias("tips_per_min"),
        round_dec(safe_div("tips", "revenue"), 4).alias("tip_share_of_revenue"),
    )


def firm_totals(
    company_mart: DataFrame, lo: str | _dt.date = "2013-01-01", hi: str | _dt.date = "2022-01-01"
) -> DataFrame:
    return (
        company_mart.filter(_between(lo, hi))
        .groupBy("company_clean")
        .agg(F.sum("trip_count").alias("trips"), exact_sum("total_revenue").alias("revenue"))
    )


def market_totals(firms: DataFrame) -> "F.Column":
    """Trips and revenue of all firms: a scalar subquery over ``firm_totals``.

    Both totals are one value, so the subquery needs the same columns of the
    firms as the report around it: its plan is the same up to the firms'
    exchange, which is computed once and reused.
    """
    return firms.agg(F.struct(F.sum("trips").alias("trips"), exact_sum("revenue").alias("revenue")).alias("market")).scalar()


def report_market_share(
    company_mart: DataFrame,
    min_trips: int = MIN_TRIPS,
    lo: str | _dt.date = "2013-01-01",
    hi: str | _dt.date = "2022-01-01",
) -> DataFrame:
    """Trip and revenue share (percent, 2 d.p.) of each firm with ``min_trips`` or more.

    The market totals include the small firms: they are taken before the
    filter, as a scalar subquery over the per-firm totals.
    """
    firms = firm_totals(company_mart, lo, hi)
    market = market_totals(firms)
    total_trips, total_revenue = market["trips"], market["revenue"]
    return (
        firms.filter(F.col("trips") >= min_trips)
        .select(
            "company_clean",
            "trips",
            round_dec("revenue", 2).alias("revenue"),
            round_dec(safe_div(F.col("trips"), total_trips) * 100, 2).alias("trip_share_pct"),
            round_dec(safe_div(F.col("revenue"), total_revenue) * 100, 2).alias("revenue_share_pct"),
        )
        .orderBy(F.desc("revenue_share_pct"))
    )


def report_payment_trend(
    company_mart: DataFrame, lo: str | _dt.date = "2013-01-01", before: str | _dt.date = "2022-01-01"
) -> DataFrame:
    """Year x payment category: trips and revenue with their share of the year."""
    base = (
        company_mart.filter((_month() >= F.lit(as_date(lo))) & (_month() < F.lit(as_date(before))))
        .groupBy(F.year(_month()).alias("year"), F.col("payment_category"))
        .agg(F.sum("trip_count").alias("trip_count"), exact_sum("total_revenue").alias("total_revenue"))
    )
    per_year = Window.partitionBy("year")
    return base.select(
        "year",
        "payment_category",
        "trip_count",
        round_dec(safe_div(F.col("trip_count"), F.sum("trip_count").over(per_year)), 4).alias("share_of_trips"),
        round_dec("total_revenue", 2).alias("total_revenue"),
        round_dec(
            safe_div(F.col("total_revenue"), exact_sum("total_revenue", over=per_year)), 4
        ).alias("share_of_revenue"),
    ).orderBy("year", F.desc("share_of_trips"))


def report_day_hour(time_mart: DataFrame, lo: str | _dt.date = "2017-01-01") -> DataFrame:
    """Week day name x hour from ``lo``; sorted by day *name*, then hour."""
    return (
        time_mart.filter(_month() >= F.lit(as_date(lo)))
        .groupBy(T.day_name("day_of_week").alias("day_name"), F.col("hour_of_day"))
        .agg(
            F.sum("trip_count").alias("trip_count"),
            exact_sum("total_revenue").alias("revenue"),
            exact_sum("total_tips").alias("tips"),
            exact_sum("total_duration_min").alias("minutes"),
        )
        .select(
            "day_name",
            "hour_of_day",
            "trip_count",
            round_dec("revenue", 2).alias("total_revenue"),
            round_dec(safe_div("tips", "trip_count"), 4).alias("avg_tip_per_trip"),
            round_dec(safe_div("tips", "revenue"), 4).alias("tip_share_of_revenue"),
            round_dec(safe_div("tips", "minutes"), 4).alias("tips_per_min"),
        )
        .orderBy("day_name", "hour_of_day")
    )


def report_seasonality(
    time_mart: DataFrame, lo: str | _dt.date = "2013-01-01", hi: str | _dt.date = "2019-12-01"
) -> DataFrame:
    """Calendar month (number, name, season) over the years in ``[lo, hi]``."""
    month_num = F.month(_month())
    return (
        time_mart.filter(_between(lo, hi))
        .groupBy(
            month_num.alias("month_num"),
            T.month_name(_month()).alias("month_name"),
            T.season(month_num).alias("season"),
        )
        .agg(
            F.sum("trip_count").alias("trip_count"),
            exact_sum("total_revenue").alias("revenue"),
            exact_sum("total_tips").alias("tips"),
            exact_sum("total_trip_km").alias("km"),
            exact_sum("total_duration_min").alias("minutes"),
        )
        .select(
            "month_num",
            "month_name",
            "season",
            "trip_count",
            round_dec("revenue", 2).alias("total_revenue"),
            round_dec(safe_div("tips", "trip_count"), 4).alias("avg_tip_per_trip"),
            round_dec(safe_div("tips", "revenue"), 4).alias("tip_share_of_revenue"),
            round_dec(safe_div("km", "trip_count"), 4).alias("avg_km_per_trip"),
            round_dec(safe_div("minutes", "trip_count"), 4).alias("avg_duration_min"),
        )
        .orderBy("month_num")
    )


def report_top_areas(geo_mart: DataFrame, k: int = 20) -> DataFrame:
    """Top ``k`` areas by trips, once as pickup and once as dropoff.

    One pass over the mart: each flow row is emitted under both roles and
    aggregated by (area, role). Ties in trips are broken by area number.
    """
    roles = F.array(
        F.struct(F.col("pickup_community_area").alias("area"), F.lit("Pickup").alias("role")),
        F.struct(F.col("dropoff_community_area").alias("area"), F.lit("Dropoff").alias("role")),
    )
    activity = (
        geo_mart.select(F.inline(roles), "trip_count", "total_revenue", "total_tips")
        .groupBy("area", "role")
        .agg(
            F.sum("trip_count").alias("trip_count"),
            exact_sum("total_revenue").alias("total_revenue"),
            exact_sum("total_tips").alias("total_tips"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("trip_count"), F.asc("area")))
    return (
        activity.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select(
            "area",
            "role",
            "trip_count",
            round_dec("total_revenue", 2).alias("total_revenue"),
            round_dec(safe_div("total_tips", "trip_count"), 4).alias("avg_tip"),
        )
        .orderBy("role", F.desc("trip_count"))
    )


def report_airport_segments(geo_mart: DataFrame) -> DataFrame:
    """Airport pickup / dropoff / city segments per airport, by average ticket."""
    return (
        geo_mart.groupBy(T.airport_segment().alias("segment"), T.airport_name().alias("airport_name"))
        .agg(
            F.sum("trip_count").alias("trip_count"),
            exact_sum("total_revenue").alias("revenue"),
            exact_sum("total_trip_km").alias("km"),
            exact_sum("total_tips").alias("tips"),
        )
        .select(
            "segment",
            "airport_name",
            "trip_count",
            round_dec("revenue", 2).alias("total_revenue"),
            round_dec(safe_div("revenue", "trip_count"), 2).alias("avg_trip_value"),
            round_dec(safe_div("km", "trip_count"), 2).alias("avg_km"),
            round_dec(safe_div("tips", "trip_count"), 4).alias("avg_tip"),
            round_dec(safe_div("tips", "revenue"), 4).alias("tip_share"),
        )
        .orderBy(F.desc("avg_trip_value"))
    )


# ---------------------------------------------------------------------------
# Results the source only shows in its comments.
# ---------------------------------------------------------------------------

TIPS_METRICS = ["avg_trip_total", "tips_per_km", "tips_per_min", "tip_share_of_revenue"]


def report_company_leaders(company_tips: DataFrame) -> DataFrame:
    """The leading firm for each tips-report metric (ties: firm name)."""
    stacked = company_tips.select(
        "company_clean",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in TIPS_METRICS])),
    )
    rank = F.row_number().over(
        Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), F.asc("company_clean"))
    )
    return stacked.withColumn("rank", rank).filter(F.col("rank") == 1).select("metric", "company_clean", "value")


def report_top5_concentration(
    company_mart: DataFrame,
    k: int = 5,
    lo: str | _dt.date = "2013-01-01",
    hi: str | _dt.date = "2022-01-01",
) -> DataFrame:
    """The ``k`` largest firms by revenue and their cumulative revenue share.

    ``orderBy().limit(k)`` plans as a top-k (TakeOrderedAndProject): each task
    keeps k rows, so only k x tasks rows meet in one place.
    """
    firms = firm_totals(company_mart, lo, hi)
    total_revenue = market_totals(firms)["revenue"]
    top = firms.orderBy(F.desc("revenue"), F.asc("company_clean")).limit(k)
    running = Window.orderBy(F.desc("revenue"), F.asc("company_clean")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return top.select(
        F.row_number().over(Window.orderBy(F.desc("revenue"), F.asc("company_clean"))).alias("rank"),
        "company_clean",
        "trips",
        round_dec("revenue", 2).alias("revenue"),
        round_dec(safe_div(F.col("revenue"), total_revenue) * 100, 2).alias("revenue_share_pct"),
        round_dec(
            safe_div(exact_sum("revenue", over=running), total_revenue) * 100, 2
        ).alias("cumulative_revenue_share_pct"),
    ).orderBy("rank")
