"""Materialised refresh: write every layer once, then report on the marts.

This is the production path (``CREATE OR REPLACE TABLE`` per layer):

    raw files -> trips_base -> audit_profile  -> 5 audits
                          -> trips_silver   -> trips_set_aside
                                            -> 3 marts -> 9 reports

Each layer is put in place as a whole by one commit, and a refresh holds the
lock of its root, so a second one there raises ``RefreshInProgress``. Each
layer is a full rebuild (or an exact month-range rebuild) written as
month-partitioned Parquet (the small audit profile: yearly) under a root in
the cluster's shared folder. Writing cuts the lineage: a lost
executor only costs the tasks of the layer being built, and later layers
scan files instead of recomputing the chain. Reads go through the guarded
reader, so every scan names its months and prunes whole partitions.
"""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from cabflow.operators import audits, layers, marts, reports
from cabflow.sources import read_raw
from cabflow.sources import versions
from cabflow.sources.layers import as_date, read_layer, write_layer
from cabflow.sources.schema import PROFILE_PARTITION, TRIP_PARTITION

FIRST_MONTH = "2013-01-01"
LAYERS = [
    "trips_base",
    "audit_profile",
    "trips_silver",
    "trips_set_aside",
    "mart_company_performance",
    "mart_time_analysis",
    "mart_geo_flows",
]
# Trips that a refresh names when it sets any aside; the layer holds all of them.
NAMED = 20


def layer_paths(root: str) -> dict[str, str]:
    return {name: f"{root.rstrip('/')}/{name}" for name in LAYERS}


def _clip(lo: str, hi: str, months: tuple[str, str] | None) -> tuple[str, str]:
    if months is None:
        return lo, hi
    return max(lo, months[0]), min(hi, months[1])


def build_layers(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    timings: dict[str, float] | None = None,
    months: tuple[str, str] | None = None,
    only: Collection[str] | None = None,
    break_lock: bool = False,
) -> dict[str, str]:
    """Rebuild base, the audit profile, silver and the marts under ``root``; return their paths.

    ``months=(lo, hi)`` (first days of months, inclusive) rebuilds only those
    month partitions of every layer (whole years of the yearly audit profile)
    and leaves the others in place; a month that has no rows any more goes.
    This is exact, not an approximation: a silver row depends only on trips
    with the same start time (the dedup key), hence of the same month, and
    every mart row is an aggregate within one month.

    Silver trips with a measure that no exact sum can hold (an infinite fare)
    are left out of the marts; the layer ``trips_set_aside`` holds them with
    measure and value, and a warning names the first.

    ``only`` rebuilds some layers alone; what they read must be there.
    ``break_lock`` takes over from a driver that died in a refresh.
    """
    with versions.refresh_lock(spark, root, break_lock):
        return _build(spark, raw, root, timings, months, set(LAYERS if only is None else only))


def _build(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    timings: dict[str, float] | None,
    months: tuple[str, str] | None,
    wanted: set[str],
) -> dict[str, str]:
    paths = layer_paths(root)
    timings = timings if timings is not None else {}
    partial = months is not None

    def step(name: str, fn: Callable[[], None]) -> None:
        start = time.perf_counter()
        fn()
        timings[name] = round(time.perf_counter() - start, 3)

    def write(df: DataFrame, name: str, **kw) -> None:
        write_layer(df, paths[name], name, **kw)

    def base() -> None:
        rows = layers.build_base(raw)
        if partial:
            month = F.col(TRIP_PARTITION)
            rows = rows.filter(month.between(F.lit(as_date(months[0])), F.lit(as_date(months[1]))))
        write(rows, "trips_base", months=months)

    if "trips_base" in wanted:
        step("trips_base", base)

    def profile() -> None:
        # One scan of base for all audits (small: days x payment words), in
        # yearly partitions; a month range rebuilds the whole years it touches.
        lo, hi = _clip(FIRST_MONTH, "9999-12-01", months)
        if partial:
            lo, hi = max(FIRST_MONTH, f"{lo[:4]}-01-01"), f"{hi[:4]}-12-01"
        base_df = read_layer(spark, paths["trips_base"], "trips_base", lo=lo, hi=hi)
        prof = audits.audit_profile(base_df).withColumn(PROFILE_PARTITION, F.year("trip_date"))
        write(prof, "audit_profile", months=(lo, hi) if partial else None)

    unsummable: list[Observation] = []

    def silver() -> None:
        lo, hi = _clip(FIRST_MONTH, "9999-12-01", months)
        base_df = read_layer(spark, paths["trips_base"], "trips_base", lo=lo, hi=hi)
        validated = layers.validated_base(layers.enrich(base_df))
        # Counted while the layer is written: silver is searched for such trips only if it has any.
        unsummable.append(Observation())

        def derive(rows: DataFrame) -> DataFrame:
            return layers.enrich(rows).observe(unsummable[0], F.count_if(layers.unsummable()).alias("trips"))

        # Only trips that may have a copy are shuffled (their base columns: the derived
        # ones are added right before the sort and the write); the others stay in the
        # ranges in which base lies. The marks are written first, so that no broadcast
        # has to wait for them.
        held = f"{root.rstrip('/')}/copies-{uuid.uuid4().hex}"
        try:
            layers.copy_marks(validated).write.parquet(held)
            alone, marked = layers.split_copies(validated, spark.read.schema("word long, bits long").parquet(held))
            write(layers.dedup(marked), "trips_silver", derive=derive, months=months, in_place=alone)
        finally:
            versions.Files(spark, root).delete(held)

    # Both read only the base layer: submit their jobs together.
    def profile_and_silver() -> None:
        with ThreadPoolExecutor(max_workers=2) as pool:
            steps = {"audit_profile": profile, "trips_silver": silver}
            for future in [pool.submit(step, name, fn) for name, fn in steps.items() if name in wanted]:
                future.result()

    step("profile_and_silver", profile_and_silver)

    def mart(name: str, build: Callable[[DataFrame], DataFrame], lo: str, hi: str) -> None:
        lo, hi = _clip(lo, hi, months)
        if lo > hi:
            return
        silver_df = read_layer(spark, paths["trips_silver"], "trips_silver", lo=lo, hi=hi)
        write(build(layers.summable(silver_df)), name, months=(lo, hi) if partial else None)

    def set_aside() -> None:
        lo, hi = _clip(FIRST_MONTH, "9999-12-01", months)
        rows = layers.set_aside(read_layer(spark, paths["trips_silver"], "trips_silver", lo=lo, hi=hi))
        if unsummable and unsummable[0].get["trips"] == 0:
            rows = rows.limit(0)
        write(rows, "trips_set_aside", months=months)

    # Each mart reads only the silver months it aggregates. The three are
    # independent, so their jobs are submitted together and share the cores.
    mart_specs = [
        ("mart_company_performance", marts.mart_company_performance, "2017-01-01", "2021-12-01"),
        ("mart_time_analysis", marts.mart_time_analysis, FIRST_MONTH, "2021-12-01"),
        ("mart_geo_flows", marts.mart_geo_flows, "2017-01-01", "2021-12-01"),
    ]

    def all_marts() -> None:
        with ThreadPoolExecutor(max_workers=len(mart_specs) + 1) as pool:
            steps = {spec[0]: lambda spec=spec: mart(*spec) for spec in mart_specs} | {"trips_set_aside": set_aside}
            for future in [pool.submit(step, name, fn) for name, fn in steps.items() if name in wanted]:
                future.result()

    step("marts", all_marts)
    if "trips_set_aside" in wanted and (named := set_aside_trips(spark, paths)):
        warnings.warn(f"left out of the marts (all in {paths['trips_set_aside']}): {'; '.join(named)}", stacklevel=3)
    return paths


def set_aside_trips(spark: SparkSession, paths: dict[str, str], limit: int = NAMED) -> list[str]:
    """The first ``limit`` trips that the marts leave out, in words; no job where there are none."""
    held = versions.manifest(spark, paths["trips_set_aside"])
    if held is None or not held.months:
        return []
    rows = read_layer(spark, paths["trips_set_aside"], "trips_set_aside").orderBy(TRIP_PARTITION, "unique_key", "measure").limit(limit)
    return [f"trip {r.unique_key} of {r.partition_month}: {r.measure} is {r.value}" for r in rows.collect()]


def collect_all(frames: dict[str, DataFrame], timings: dict[str, float] | None = None, workers: int = 4):
    """Run independent small result sets as concurrent jobs; return their rows."""
    timings = timings if timings is not None else {}

    def run(name: str):
        start = time.perf_counter()
        rows = frames[name].collect()
        timings[name] = round(time.perf_counter() - start, 3)
        return name, rows

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return dict(pool.map(run, frames))


def layer_reports(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Audits on the written audit profile and reports on the written marts (lazy)."""

    def profile(lo: str = FIRST_MONTH) -> DataFrame:
        return read_layer(spark, paths["audit_profile"], "audit_profile", lo=lo).drop(PROFILE_PARTITION)

    def company(lo: str, hi: str) -> DataFrame:
        return read_layer(spark, paths["mart_company_performance"], "mart_company_performance", lo=lo, hi=hi)

    def time_mart(lo: str, hi: str | None = None) -> DataFrame:
        return read_layer(spark, paths["mart_time_analysis"], "mart_time_analysis", lo=lo, hi=hi)

    geo = read_layer(spark, paths["mart_geo_flows"], "mart_geo_flows")
    monthly = audits.audit_nulls(profile(audits.MONTHLY_FIRST_MONTH), by="month")
    tips = reports.report_company_tips(company("2017-01-01", "2021-12-01"))
    return {
        "audit_nulls_yearly": audits.audit_nulls(profile(), by="year"),
        "audit_nulls_monthly": monthly,
        "audit_month_status": audits.audit_month_status(monthly),
        "audit_payment_types": audits.audit_payment_types(profile()),
        "audit_anomalies": audits.audit_anomalies(profile()),
        "report_company_tips": tips,
        "report_market_share": reports.report_market_share(company("2013-01-01", "2022-01-01")),
        "report_payment_trend": reports.report_payment_trend(company("2013-01-01", "2021-12-01")),
        "report_day_hour": reports.report_day_hour(time_mart("2017-01-01")),
        "report_seasonality": reports.report_seasonality(time_mart("2013-01-01", "2019-12-01")),
        "report_top_areas": reports.report_top_areas(geo),
        "report_airport_segments": reports.report_airport_segments(geo),
        "report_company_leaders": reports.report_company_leaders(tips),
        "report_top5_concentration": reports.report_top5_concentration(company("2013-01-01", "2022-01-01")),
    }


def register_views(
    spark: SparkSession, paths: dict[str, str], lo: str | None = None, hi: str | None = None
) -> list[str]:
    """Expose the written layers to Spark SQL under the analysis' table names.

    ``trips_base``, ``v_trips_enriched`` (the lazy enriched view),
    ``trips_silver`` and the three marts become temporary views, so SQL
    written against those names runs unchanged in dialect-neutral parts. The
    guarded layers are exposed over the months ``[lo, hi]`` only; without a
    bound this raises, as ``read_layer`` does. A ``WHERE partition_month …`` /
    ``month_start …`` bound prunes further.
    """
    for name, path in paths.items():
        read_layer(spark, path, name, lo=lo, hi=hi).createOrReplaceTempView(name)
    layers.enrich(spark.table("trips_base")).createOrReplaceTempView("v_trips_enriched")
    return [*paths, "v_trips_enriched"]


def refresh_from_files(
    spark: SparkSession, raw_path: str, root: str, months: tuple[str, str] | None = None, break_lock: bool = False
) -> dict[str, str]:
    """Rebuild from raw trip files."""
    return build_layers(spark, read_raw(spark, raw_path), root, months=months, break_lock=break_lock)
