"""Layers, audits, marts and reports (all ``DataFrame -> DataFrame``)."""

from cabflow.operators.audits import (
    audit_anomalies,
    audit_month_status,
    audit_nulls,
    audit_payment_types,
)
from cabflow.operators.layers import build_base, build_silver, dedup, enrich, quality_rules, validate
from cabflow.operators.marts import mart_company_performance, mart_geo_flows, mart_time_analysis
from cabflow.operators.reports import (
    report_airport_segments,
    report_company_leaders,
    report_company_tips,
    report_day_hour,
    report_market_share,
    report_payment_trend,
    report_seasonality,
    report_top5_concentration,
    report_top_areas,
)

__all__ = [
    "audit_anomalies",
    "audit_month_status",
    "audit_nulls",
    "audit_payment_types",
    "build_base",
    "build_silver",
    "dedup",
    "enrich",
    "quality_rules",
    "validate",
    "mart_company_performance",
    "mart_geo_flows",
    "mart_time_analysis",
    "report_airport_segments",
    "report_company_leaders",
    "report_company_tips",
    "report_day_hour",
    "report_market_share",
    "report_payment_trend",
    "report_seasonality",
    "report_top5_concentration",
    "report_top_areas",
]
