"""Registry: one ``(spark, sf_dir) -> DataFrame`` per query of the analysis.

Every query starts from the test folder's ``lineitem`` (through the raw
trip adapter) and runs the whole chain lazily, so its work grows with the
table and Catalyst optimises across layers (the month is one of the dedup's
keys, so the month bounds of a mart filter the rows below the dedup). The
materialised path — each layer written once and read back — is
``cabflow.plans.refresh``; the ``written_…`` queries run it and give what
the guarded reader finds.

Building a query sets the session's ``RUNTIME_CONF`` (``cabflow.session``):
UTC, adaptive execution and the codegen method limit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cabflow.operators import audits, layers, marts, reports
from cabflow.plans.refresh import FIRST_MONTH, build_layers
from cabflow.session import scratch_dir, tune_session
from cabflow.sources.fixture import raw_trips
from cabflow.sources.layers import read_layer

Query = Callable[[SparkSession, str], DataFrame]


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.build_base(raw_trips(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.enrich(_base(spark, sf_dir))


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.build_silver(_enriched(spark, sf_dir))


def _company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.mart_company_performance(_silver(spark, sf_dir))


def _time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.mart_time_analysis(_silver(spark, sf_dir))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.mart_geo_flows(_silver(spark, sf_dir))


def _written(layer: str, *needs: str, months: tuple[tuple[str, str], ...] = (), lo: str | None = FIRST_MONTH) -> Query:
    """Write ``needs`` and ``layer`` under the shared folder, then read the layer through the guard.

    With ``months`` the layers are first written whole and then once more,
    those months only, so that the result mixes two versions.
    """

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = f"{scratch_dir(spark).rstrip('/')}/cabflow-written/{layer}-{uuid.uuid4().hex}"
        for part in (None, *months):
            paths = build_layers(spark, raw_trips(spark, sf_dir), root, months=part, only={*needs, layer})
        return read_layer(spark, paths[layer], layer, lo=lo)

    return build


QUERIES: dict[str, Query] = {
    # raw and base
    "trips_raw": raw_trips,
    "trips_base": _base,
    "audit_nulls_yearly": lambda s, d: audits.audit_nulls(_base(s, d), by="year"),
    "audit_nulls_monthly": lambda s, d: audits.audit_nulls(_base(s, d), by="month"),
    "audit_month_status": lambda s, d: audits.audit_month_status(audits.audit_nulls(_base(s, d), by="month")),
    "audit_payment_types": lambda s, d: audits.audit_payment_types(_base(s, d)),
    # enriched, validated, silver
    "trips_enriched": _enriched,
    "audit_anomalies": lambda s, d: audits.audit_anomalies(_enriched(s, d)),
    "trips_validated": lambda s, d: layers.validate(_enriched(s, d)),
    "trips_silver": _silver,
    # marts
    "mart_company_performance": _company,
    "mart_time_analysis": _time,
    "mart_geo_flows": _geo,
    # reports
    "report_company_tips": lambda s, d: reports.report_company_tips(_company(s, d)),
    "report_market_share": lambda s, d: reports.report_market_share(_company(s, d)),
    "report_payment_trend": lambda s, d: reports.report_payment_trend(_company(s, d)),
    "report_day_hour": lambda s, d: reports.report_day_hour(_time(s, d)),
    "report_seasonality": lambda s, d: reports.report_seasonality(_time(s, d)),
    "report_top_areas": lambda s, d: reports.report_top_areas(_geo(s, d)),
    "report_airport_segments": lambda s, d: reports.report_airport_segments(_geo(s, d)),
    "report_company_leaders": lambda s, d: reports.report_company_leaders(
        reports.report_company_tips(_company(s, d))
    ),
    "report_top5_concentration": lambda s, d: reports.report_top5_concentration(_company(s, d)),
    # the written path: layers in versions under the shared folder, read through the guard
    "written_trips_base": _written("trips_base", months=(("2016-03-01", "2018-06-01"),)),
    "written_trips_silver": _written("trips_silver", "trips_base", months=(("2019-01-01", "2019-12-01"),)),
    "written_mart_company_performance": _written("mart_company_performance", "trips_base", "trips_silver"),
    "written_mart_geo_flows": _written("mart_geo_flows", "trips_base", "trips_silver", lo=None),
}


def _tuned(fn: Query) -> Query:
    """Apply the session settings the library relies on, then build the query."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune_session(spark)
        return fn(spark, sf_dir)

    build.__name__ = getattr(fn, "__name__", "query")
    return build


QUERIES = {name: _tuned(fn) for name, fn in QUERIES.items()}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
