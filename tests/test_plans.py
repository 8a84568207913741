"""Plan-shape regression tests: no cross products, no Python in the plans,
no distinct-aggregate expansion over base data, filters and projections
pushed into the Parquet scans."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from tidemark.plans import registry, reports
from tidemark.sources.driver_data import load_app_tables

# Keys whose plans legitimately contain Expand: unpivots of one-row / few-row results.
EXPAND_OK = {"integrity_audit", "integrity_audit_defects", "briefing_context", "briefing_text"}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]


def executed_plan(df) -> str:
    """The plan that ran: the frame's own execution is forced, so that the
    adaptive plan printed is its final one."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    plan = execution.executedPlan()
    assert "isFinalPlan=false" not in plan.toString()
    return (plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan).toString()


def build(spark, key):
    """A report's lazy plan, also of those that the registry materialises."""
    return registry.REPORTS[key](load_app_tables(spark, SF_SMALL))


@pytest.mark.parametrize("key", sorted(registry.REPORTS))
def test_plan_has_no_cross_product_or_python(spark, key):
    plan = executed_plan(build(spark, key))
    for node in FORBIDDEN:
        assert node not in plan, (key, node)
    if key not in EXPAND_OK:
        assert "Expand" not in plan, key


def event_scans(plan: str) -> list[str]:
    return [x for x in plan.splitlines() if "FileScan parquet" in x and "event_type#" in x]


@pytest.mark.parametrize(
    "key", ["segment_performance", "business_kpis", "business_kpis_sql", "topline_kpis", "topline_kpis_sql", "funnel_sessions", "risk_bands"]
)
def test_mart_reports_sort_nothing_and_aggregate_events_once(spark, key):
    plan = executed_plan(build(spark, key))
    assert len(event_scans(plan)) == 1, plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("key", ["past_purchases", "cart_features", "feature_sample"])
def test_prior_orders_come_from_the_rollup(spark, key):
    """One scan of the events, one exchange by session and one by user."""
    plan = executed_plan(build(spark, key))
    assert len([x for x in plan.splitlines() if "FileScan parquet" in x]) == 1, plan
    assert plan.count("Exchange hashpartitioning(session_id") == 1
    assert plan.count("Exchange hashpartitioning(user_id") == 1 and "Join" not in plan


def test_sessions_come_from_one_hash_aggregation(spark):
    plan = executed_plan(build(spark, "sessions_built"))
    assert "SortAggregate" not in plan and plan.count("HashAggregate(keys=[session_id") == 2
    assert plan.count("Exchange hashpartitioning") == 1


def test_channel_filter_reaches_the_customer_scan(spark):
    df = build(spark, "funnel_sessions_channel")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan


def test_event_scan_reads_only_needed_columns(spark):
    df = build(spark, "user_active_days")
    plan = df._jdf.queryExecution().executedPlan().toString()
    event_scans = [line for line in plan.splitlines() if "events.parquet" in line or "ReadSchema" in line]
    assert event_scans
    schemas = [line for line in plan.splitlines() if "ReadSchema: struct<" in line and "ts:" in line]
    # active days need the user and the day, never the payload columns
    for line in schemas:
        assert "value:" not in line


def test_funnel_joins_users_after_per_user_aggregation(spark):
    df = reports.funnel_sessions(load_app_tables(spark, SF_SMALL), channel="BUILDING")
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    # The join with users happens above an aggregate keyed by user_id.
    join_at = optimized.find("Join Inner")
    assert join_at >= 0
    assert "Aggregate [user_id" in optimized[join_at:]
