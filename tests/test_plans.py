"""Physical plan shape: JVM-only expressions, skew-safe dedup, no joins for totals, pruning."""

import os
import uuid

import pytest

from cabflow.operators import audits, marts
from cabflow.plans.check import plan_text
from cabflow.plans.queries import QUERIES
from cabflow.plans.refresh import build_layers
from cabflow.sources.fixture import raw_trips
from cabflow.sources.layers import read_layer

from conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_any_plan(spark, name):
    plan = plan_text(QUERIES[name](spark, SF_SMALL))
    assert not any(node in plan for node in PYTHON_NODES)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _tree(plan: str) -> str:
    return plan.split("\n\n\n")[0]


def test_dedup_limits_before_the_shuffle(spark):
    tree = _tree(plan_text(QUERIES["trips_silver"](spark, SF_SMALL)))
    final = tree.index("WindowGroupLimit")
    exchange = tree.index("Exchange", final)
    partial = tree.index("WindowGroupLimit", exchange)
    assert final < exchange < partial
    assert "hashpartitioning(taxi_id" in plan_text(QUERIES["trips_silver"](spark, SF_SMALL))


def test_market_share_total_is_a_scalar_subquery(spark):
    plan = plan_text(QUERIES["report_market_share"](spark, SF_SMALL))
    assert "Subquery" in plan
    assert "Join" not in _tree(plan)


@pytest.mark.parametrize("name", ["report_market_share", "report_top5_concentration"])
def test_market_totals_share_the_firms_exchange(spark, name):
    """On the executed plan, subqueries included, the table is read once."""
    from cabflow.plans.check import scans

    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    read = scans(df)
    assert len(read) == 1 and read[0] == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()


def test_top_areas_uses_group_limit(spark):
    assert "WindowGroupLimit" in plan_text(QUERIES["report_top_areas"](spark, SF_SMALL))


@pytest.fixture(scope="module")
def paths(spark, scratch):
    root = os.path.join(scratch, f"plans-{uuid.uuid4().hex[:8]}")
    return build_layers(spark, raw_trips(spark, SF_SMALL), root)


def test_marts_prune_months_and_columns(spark, paths):
    silver = read_layer(spark, paths["trips_silver"], "trips_silver", lo="2017-01-01", hi="2021-12-01")
    plan = plan_text(marts.mart_geo_flows(silver))
    assert "PartitionFilters: [isnotnull(partition_month" in plan
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "company" not in read_schema and "unique_key" not in read_schema
    assert "PushedFilters: [IsNotNull(pickup_community_area), IsNotNull(dropoff_community_area)]" in plan


def test_audit_is_one_pruned_scan(spark, paths):
    base = read_layer(spark, paths["trips_base"], "trips_base", lo="2013-01-01")
    plan = plan_text(audits.audit_nulls(base))
    assert _tree(plan).count("Scan parquet") == 1
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "unique_key" not in read_schema and "taxi_id" not in read_schema


def test_month_bound_is_below_the_dedup(spark):
    tree = _tree(plan_text(QUERIES["mart_geo_flows"](spark, SF_SMALL)))
    details = plan_text(QUERIES["mart_geo_flows"](spark, SF_SMALL)).split("\n\n")
    assert "Window" in tree
    # Every filter over the scan side names both bounds of the mart before any exchange.
    filters = [d for d in details if d.lstrip("(0123456789) ").startswith("Filter")]
    assert any("2017-01-01" in f and "2021-12-01" in f for f in filters[:1])


def test_month_bound_reduces_dedup_rows(spark):
    """The dedup exchange of a bounded mart carries fewer rows than that of silver."""

    def dedup_rows(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        found = []

        def walk(node):
            name = node.nodeName()
            if name.startswith("AdaptiveSparkPlan"):
                walk(node.executedPlan())
            elif "QueryStage" in name:
                walk(node.plan())
            else:
                if name == "Exchange" and "taxi_id" in node.simpleString(200):
                    found.append(node.metrics().apply("shuffleRecordsWritten").value())
                for i in range(node.children().size()):
                    walk(node.children().apply(i))

        walk(plan)
        return found[0]

    bounded = dedup_rows(QUERIES["mart_geo_flows"](spark, SF_SMALL))
    everything = dedup_rows(QUERIES["trips_silver"](spark, SF_SMALL))
    assert 0 < bounded < 0.8 * everything


def test_audits_shuffle_one_row_per_key_and_task(spark):
    df = QUERIES["audit_nulls_yearly"](spark, SF_SMALL)
    years = df.count()
    tree = _tree(plan_text(df))
    assert tree.count("HashAggregate") == 2  # partial and final, by year alone
    assert "trip_date" not in plan_text(df)
    assert years <= 20


def test_silver_shuffles_only_base_columns(spark):
    plan = plan_text(QUERIES["trips_silver"](spark, SF_SMALL))
    details = plan.split("\n\n")
    exchanges = [d for d in details if "Exchange" in d.split("\n")[0] and "hashpartitioning(taxi_id" in d]
    assert exchanges
    for block in exchanges:
        inputs = next(line for line in block.split("\n") if line.startswith("Input"))
        assert "company_clean" not in inputs and "dollars_per_km" not in inputs
        assert inputs.startswith("Input [24]")
