"""Cross-report invariants and sanity anchors on the sf0.01 test data."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from tidemark.plans import ml, reports
from tidemark.plans.mart import session_mart
from tidemark.sources.driver_data import load_app_tables


@pytest.fixture(scope="module")
def tables(spark):
    return load_app_tables(spark, SF_ORACLE)


def test_anchor_row_counts(tables):
    counts = {r["table_name"]: r["row_count"] for r in reports.table_counts(tables).collect()}
    assert counts == {"users": 1500, "events": 10000, "sessions": 4006, "orders": 1981, "experiments": 1500}


def test_anchor_session_funnel(tables):
    vols = [r["session_volume"] for r in reports.funnel_sessions(tables).orderBy("stage_idx").collect()]
    assert vols == [1611, 870, 929, 1601, 1612, 1604]


def test_anchor_user_funnel(tables):
    got = {
        r["device_type"]: [r["app_open_users"], r["search_users"], r["view_product_users"], r["add_to_cart_users"],
                           r["checkout_users"], r["purchase_users"]]
        for r in reports.funnel_by_device(tables).collect()
    }
    assert got == {
        "Android": [148, 118, 127, 148, 148, 150],
        "Web": [139, 131, 127, 148, 144, 149],
        "iOS": [150, 132, 133, 144, 147, 146],
    }


def test_anchor_retention_and_segments(tables):
    grid = {r["acquisition_channel"]: (r["cohort_size"], r["d0_users"], r["d1_users"], r["d1_retention_pct"], r["d7_users"])
            for r in reports.retention_grid(tables).collect()}
    assert grid["AUTOMOBILE"] == (298, 22, 21, 7.05, 23)
    assert grid["BUILDING"] == (302, 30, 31, 10.26, 32)
    seg = {r["user_segment"]: r["user_count"] for r in reports.segment_performance(tables).collect()}
    assert seg == {"New User": 375, "Repeat User": 115, "Dormant User": 1010}


def test_anchor_ab_kpis_features(tables):
    sig = reports.ab_significance(tables).collect()[0]
    assert (sig["n_a"], sig["x_a"], sig["n_b"], sig["x_b"]) == (813, 304, 799, 282)
    assert sig["z_score"] ** 2 == pytest.approx(0.766786, abs=1e-6)
    p = reports.ab_pvalue(tables).collect()[0]
    assert p["chi2_statistic"] == pytest.approx(sig["z_score"] ** 2, abs=1e-6)
    assert p["p_value"] == pytest.approx(math.erfc(abs(sig["z_score"]) / math.sqrt(2)), abs=2e-6)
    kpi = reports.business_kpis(tables).collect()[0]
    assert kpi["total_revenue"] == 95455.77 and kpi["avg_order_value"] == 48.19 and kpi["total_orders"] == 1604
    f = ml.cart_features(tables).agg(
        F.count("*").alias("n"), F.sum("past_purchases_count").alias("pp"), F.sum("abandoned").alias("ab"),
        F.sum("is_ios").alias("ios"),
    ).collect()[0]
    assert tuple(f) == (1601, 10371, 1010, 568)


def test_retention_formulations_agree(tables):
    a = {r["acquisition_channel"]: (r["cohort_size"], r["d0_users"], r["d1_users"], r["d7_users"])
         for r in reports.retention_grid(tables).collect()}
    b = {r["acquisition_channel"]: (r["total_users"], r["d0_users"], r["d1_users"], r["d7_users"])
         for r in reports.retention_validation(tables).collect()}
    c = {r["acquisition_channel"]: (r["cohort_size"], r["day1_active_users"], r["day7_active_users"])
         for r in reports.retention_by_channel(tables).collect()}
    assert a == b
    assert {k: (v[0], v[2], v[3]) for k, v in a.items()} == c


def test_ab_rounding_and_segment_sums(tables):
    rounded = {r["experiment_group"]: r["conversion_rate_pct"] for r in reports.ab_results(tables).collect()}
    raw = {r["experiment_group"]: r["conversion_rate_pct"] for r in reports.ab_raw(tables).collect()}
    assert rounded == {k: round(v + 1e-12, 2) for k, v in raw.items()}
    total = sum(r["cnt"] for r in reports.segment_by_channel(tables).collect())
    assert total == tables.users.count()


def test_session_funnel_is_sum_over_devices(tables):
    mart = session_mart(tables)
    all_dev = [r["session_volume"] for r in reports.funnel_sessions(tables, mart=mart).orderBy("stage_idx").collect()]
    per_dev = [0] * 6
    for device in ("iOS", "Android", "Web"):
        vols = reports.funnel_sessions(tables, device_type=device, mart=mart).orderBy("stage_idx").collect()
        per_dev = [a + r["session_volume"] for a, r in zip(per_dev, vols)]
    assert all_dev == per_dev
