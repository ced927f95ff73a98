"""Report semantics on hand-made marts (the traps of the source SQL)."""

import datetime as dt

from cabflow.operators import reports

COMPANY_MART = (
    "month_start date, company_clean string, payment_category string, is_airport_trip boolean, "
    "trip_count long, active_taxis long, total_revenue double, total_fare double, total_tips double, "
    "total_trip_km double, total_duration_min double"
)


def company_rows(spark, rows):
    return spark.createDataFrame(rows, COMPANY_MART)


def test_market_share_denominator_includes_small_firms(spark):
    m = dt.date(2018, 1, 1)
    mart = company_rows(
        spark,
        [
            (m, "Big", "Card", False, 3000, 10, 30000.0, 0.0, 0.0, 0.0, 0.0),
            (m, "Small", "Cash", False, 999, 3, 10000.0, 0.0, 0.0, 0.0, 0.0),
        ],
    )
    (row,) = reports.report_market_share(mart).collect()
    assert row.company_clean == "Big"
    assert row.trip_share_pct == round(3000 / 3999 * 100, 2)
    assert row.revenue_share_pct == 75.0


def test_payment_trend_shares_within_each_year(spark):
    rows = [
        (dt.date(2019, 5, 1), "A", "Card", False, 1, 1, 0.01, 0.0, 0.0, 0.0, 0.0),
        (dt.date(2019, 5, 1), "A", "Cash", False, 1, 1, 0.01, 0.0, 0.0, 0.0, 0.0),
        (dt.date(2019, 9, 1), "B", "Cash", True, 2, 1, 0.01, 0.0, 0.0, 0.0, 0.0),
        (dt.date(2020, 1, 1), "B", "Cash", True, 7, 1, 5.00, 0.0, 0.0, 0.0, 0.0),
    ]
    got = {(r.year, r.payment_category): r for r in reports.report_payment_trend(company_rows(spark, rows)).collect()}
    assert got[(2019, "Card")].share_of_revenue == 0.3333 and got[(2019, "Cash")].share_of_revenue == 0.6667
    assert got[(2019, "Cash")].share_of_trips == 0.75 and got[(2019, "Cash")].total_revenue == 0.02
    assert got[(2020, "Cash")].share_of_trips == 1.0


def test_day_hour_sorted_by_day_name(spark):
    rows = [(dt.date(2018, 1, 1), d, 7, 10, 5, 100.0, 10.0, 30.0, 60.0) for d in range(1, 8)]
    mart = spark.createDataFrame(
        rows,
        "month_start date, day_of_week int, hour_of_day int, trip_count long, tipped_trip_count long, "
        "total_revenue double, total_tips double, total_trip_km double, total_duration_min double",
    )
    names = [r.day_name for r in reports.report_day_hour(mart).collect()]
    assert names == ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]


def test_top_areas_ties_broken_by_area(spark):
    rows = [(dt.date(2018, 1, 1), area, 8, False, 5, 50.0, 10.0, 20.0, 5.0) for area in (30, 10, 20)]
    geo = spark.createDataFrame(
        rows,
        "month_start date, pickup_community_area long, dropoff_community_area long, is_airport_trip boolean, "
        "trip_count long, total_revenue double, total_trip_km double, total_duration_min double, total_tips double",
    )
    got = reports.report_top_areas(geo, k=2).collect()
    pickups = [r.area for r in got if r.role == "Pickup"]
    assert pickups == [10, 20]
    (dropoff,) = [r for r in got if r.role == "Dropoff"]
    assert (dropoff.area, dropoff.trip_count, dropoff.avg_tip) == (8, 15, 1.0)


def test_company_tips_threshold_is_on_summed_trips(spark):
    mart = company_rows(
        spark,
        [
            (dt.date(2018, m, 1), "Split", "Card", False, 500, 2, 5000.0, 4000.0, 500.0, 2000.0, 6000.0)
            for m in (1, 2)
        ],
    )
    (row,) = reports.report_company_tips(mart).collect()
    assert (row.avg_trip_total, row.tips_per_km, row.tips_per_min, row.tip_share_of_revenue) == (10.0, 0.25, 0.0833, 0.1)
