"""Invariants from the source's pasted results and the fixture's known counts."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from cabflow.operators import audits, layers, reports
from cabflow.plans.refresh import build_layers, layer_reports
from cabflow.sources.fixture import raw_trips
from cabflow.sources.layers import read_layer

from conftest import SF_MEDIUM, SF_SMALL

# FIXTURES.md §3: trips, base, validated, silver, company mart, time mart, geo mart
EXPECTED_COUNTS = {
    SF_SMALL: (6116, 6106, 5708, 5576, 1334, 4419, 1975),
    SF_MEDIUM: (61176, 61133, 55969, 54671, 2622, 16088, 12821),
}


@pytest.fixture(scope="module")
def medium(spark, scratch):
    root = os.path.join(scratch, f"inv-{uuid.uuid4().hex[:8]}")
    paths = build_layers(spark, raw_trips(spark, SF_MEDIUM), root)
    return paths, {k: v.collect() for k, v in layer_reports(spark, paths).items()}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MEDIUM])
def test_layer_counts(spark, sf):
    from cabflow.operators import marts

    raw = raw_trips(spark, sf)
    base = layers.build_base(raw)
    enriched = layers.enrich(base)
    silver = layers.build_silver(enriched).cache()
    got = (
        raw.count(),
        base.count(),
        layers.validate(enriched).count(),
        silver.count(),
        marts.mart_company_performance(silver).count(),
        marts.mart_time_analysis(silver).count(),
        marts.mart_geo_flows(silver).count(),
    )
    silver.unpersist()
    assert got == EXPECTED_COUNTS[sf]


def test_rejects_per_rule(spark):
    """Rows each silver rule rejects alone (FALSE or NULL) at sf0.01."""
    enriched = layers.enrich(layers.build_base(raw_trips(spark, SF_MEDIUM)))
    rules = layers.quality_rules()
    counts = enriched.agg(
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    ).first()
    assert counts.asDict() == {
        "month_bound": 0,
        "fare_not_negative": 304,
        "tips_not_negative": 356,
        "total_not_negative": 229,
        "total_capped": 167,
        "price_per_km": 528,
        "end_after_start": 335,
        "not_ghost": 323,
        "duration_capped": 112,
        "paid_if_moved": 2253,
        "distance_capped": 279,
        "speed_capped": 1100,
    }


def test_row_conservation_between_audits(spark, medium):
    paths, out = medium
    base_rows = read_layer(spark, paths["trips_base"], "trips_base", lo="2013-01-01").count()
    assert sum(r.total_rows for r in out["audit_nulls_yearly"]) == base_rows
    assert sum(r.total_occurrences for r in out["audit_payment_types"]) == base_rows
    assert sum(r.total_rows for r in out["audit_anomalies"]) == base_rows
    monthly_2022 = sum(r.total_rows for r in out["audit_nulls_monthly"] if r.year == 2022)
    assert monthly_2022 == next(r.total_rows for r in out["audit_nulls_yearly"] if r.year == 2022)


def test_payment_map_totals(medium):
    _, out = medium
    words = {r.payment_type: r.total_occurrences for r in out["audit_payment_types"]}
    known = {"Credit Card", "Prcard", "Pcard", "Prepaid", "Way2ride", "Cash", "Mobile", "No Charge", "Dispute"}
    unknown = sum(n for w, n in words.items() if w not in known)
    assert sum(r.payment_unknown for r in out["audit_anomalies"]) == unknown
    assert sum(r.payment_no_revenue for r in out["audit_anomalies"]) == words["No Charge"] + words["Dispute"]


def test_anomaly_percentages_match_counts(medium):
    _, out = medium
    for r in out["audit_anomalies"]:
        assert r.ghost_pct == round(r.ghost_trips / r.total_rows * 100, 3)
        assert r.mismatch_pct == round(r.total_mismatch / r.total_rows * 100, 3)


def test_silver_is_unique_per_taxi_and_start(spark, medium):
    paths, _ = medium
    silver = read_layer(spark, paths["trips_silver"], "trips_silver", lo="2013-01-01")
    assert silver.groupBy("taxi_id", "trip_start_timestamp").count().filter("count > 1").count() == 0


def test_marts_add_up_to_silver(spark, medium):
    paths, _ = medium
    silver = read_layer(spark, paths["trips_silver"], "trips_silver", lo="2013-01-01")
    in_range = silver.filter(F.col("partition_month").between("2017-01-01", "2021-12-01"))
    company = read_layer(spark, paths["mart_company_performance"], "mart_company_performance", lo="2013-01-01")
    time_mart = read_layer(spark, paths["mart_time_analysis"], "mart_time_analysis", lo="2013-01-01")
    geo = read_layer(spark, paths["mart_geo_flows"], "mart_geo_flows")
    assert company.agg(F.sum("trip_count")).first()[0] == in_range.count()
    assert time_mart.agg(F.sum("trip_count")).first()[0] == silver.filter("partition_month < '2022-01-01'").count()
    with_geo = in_range.filter("pickup_community_area IS NOT NULL AND dropoff_community_area IS NOT NULL")
    assert geo.agg(F.sum("trip_count")).first()[0] == with_geo.count()


def test_both_roles_count_every_flow(spark, medium):
    paths, _ = medium
    geo = read_layer(spark, paths["mart_geo_flows"], "mart_geo_flows")
    everything = reports.report_top_areas(geo, k=10_000).groupBy("role").agg(F.sum("trip_count").alias("n"))
    total = geo.agg(F.sum("trip_count")).first()[0]
    assert {r.role: r.n for r in everything.collect()} == {"Pickup": total, "Dropoff": total}


def test_airport_report_at_sf001(medium):
    _, out = medium
    got = {(r.segment, r.airport_name): r.trip_count for r in out["report_airport_segments"]}
    assert got == {
        ("Airport Dropoff", "Midway"): 2063,
        ("Airport Dropoff", "OHare"): 1524,
        ("Airport Pickup", "Midway"): 2635,
        ("Airport Pickup", "OHare"): 3025,
        ("Non-Airport", "City"): 18337,
    }
    for r in out["report_airport_segments"]:
        assert r.avg_trip_value == round(r.total_revenue / r.trip_count, 2)


def test_firms_and_shares(medium):
    _, out = medium
    firms = sorted(r.company_clean for r in out["report_market_share"])
    assert firms == ["Alpha Cab", "Beta Taxi", "Delta Service", "Gamma Cars Inc", "Independent / Unknown"]
    assert len(out["report_company_tips"]) == 5
    by_year = {}
    for r in out["report_payment_trend"]:
        by_year.setdefault(r.year, []).append(r.share_of_trips)
    for shares in by_year.values():
        assert abs(sum(shares) - 1) < 1e-3


def test_top5_cumulative_share(medium):
    _, out = medium
    rows = out["report_top5_concentration"]
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    cumulative = [r.cumulative_revenue_share_pct for r in rows]
    assert cumulative == sorted(cumulative)
    assert abs(cumulative[-1] - sum(r.revenue_share_pct for r in rows)) < 0.05


def test_month_status_labels(medium):
    _, out = medium
    fullest = max(r.total_rows for r in out["audit_month_status"])
    for r in out["audit_month_status"]:
        expected = "BROKEN" if r.distinct_days <= 1 else ("LOW" if r.total_rows < audits.LOW_SHARE * fullest else "OK")
        assert r.status == expected
    assert {r.status for r in out["audit_month_status"]} == {"OK", "LOW", "BROKEN"}
