"""Hand-made edge cases for the report semantics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from helpers import event, experiment, make_tables, order, session, user
from tidemark.operators import audit, entities, history
from tidemark.plans import ml, reports
from tidemark.sources import schemas


def rows(df, *order_by):
    return [r.asDict() for r in (df.orderBy(*order_by) if order_by else df).collect()]


def test_no_sessions_at_all(spark):
    t = make_tables(spark, users=[user(1)])
    kpi = rows(reports.business_kpis(t))[0]
    assert kpi == {
        "total_revenue": 0.0,
        "avg_order_value": 0.0,
        "conversion_rate": 0.0,
        "abandonment_rate": 100.0,
        "total_orders": 0,
        "total_sessions": 1,
    }
    top = rows(reports.topline_kpis(t))[0]
    assert all(v is None for v in top.values())
    funnel = rows(reports.funnel_sessions(t), "stage_idx")
    assert [r["session_volume"] for r in funnel] == [0] * 6
    assert [r["step_conversion_pct"] for r in funnel] == [100.0, 0, 0, 0, 0, 0]
    assert [r["step_dropoff_pct"] for r in funnel] == [0.0, 100.0, 100.0, 100.0, 100.0, 100.0]
    assert [r["funnel_stage"] for r in funnel] == schemas.STAGES


def test_user_without_sessions_stays_in_cohort_and_segments(spark):
    t = make_tables(
        spark,
        users=[user(1, signup=0, channel="A"), user(2, signup=0, channel="A", segment="Dormant User")],
        sessions=[session(10, 1, d=1)],
        events=[event(10, 1, "App Open", d=1)],
    )
    grid = rows(reports.retention_grid(t))[0]
    assert grid["cohort_size"] == 2 and grid["d1_users"] == 1 and grid["d1_retention_pct"] == 50.0
    seg = {r["user_segment"]: r for r in rows(reports.segment_performance(t))}
    assert seg["Dormant User"]["user_count"] == 1 and seg["Dormant User"]["total_sessions"] == 0
    assert seg["Dormant User"]["total_spend_usd"] == 0.0 and seg["Dormant User"]["arpu"] == 0.0


def test_session_without_events(spark):
    t = make_tables(
        spark,
        users=[user(1), user(2)],
        sessions=[session(10, 1, device="Web"), session(11, 2, device="iOS")],
        events=[event(11, 2, "Add To Cart")],
    )
    by_dev = {r["device_type"]: r for r in rows(reports.funnel_by_device(t))}
    assert by_dev["Web"]["app_open_users"] == 0 and by_dev["Web"]["search_step_conv_pct"] is None
    dc = {r["device_type"] for r in rows(reports.device_checkout(t))}
    assert dc == {"iOS"}


def test_user_on_two_devices_counts_in_both(spark):
    t = make_tables(
        spark,
        users=[user(1)],
        sessions=[session(10, 1, d=0, device="iOS"), session(11, 1, d=1, device="Web")],
        events=[event(10, 1, "App Open"), event(11, 1, "App Open", d=1)],
    )
    by_dev = {r["device_type"]: r["app_open_users"] for r in rows(reports.funnel_by_device(t))}
    assert by_dev == {"iOS": 1, "Web": 1}


def test_two_orders_in_one_session(spark):
    t = make_tables(
        spark,
        users=[user(1, segment="Repeat User")],
        sessions=[session(10, 1)],
        events=[event(10, 1, "Purchase"), event(10, 1, "Purchase")],
        orders=[order(1, 1, 10, 10.0), order(2, 1, 10, 30.0)],
    )
    kpi = rows(reports.business_kpis(t))[0]
    assert kpi["total_orders"] == 1 and kpi["avg_order_value"] == 20.0 and kpi["total_revenue"] == 40.0
    seg = rows(reports.segment_performance(t))[0]
    assert seg["total_sessions"] == 1 and seg["total_spend_usd"] == 40.0


def test_user_in_two_groups_and_purchase_without_checkout(spark):
    t = make_tables(
        spark,
        users=[user(1), user(2)],
        sessions=[session(10, 1), session(11, 2)],
        events=[event(10, 1, "Checkout"), event(10, 1, "Purchase"), event(11, 2, "Purchase")],
        experiments=[experiment(1, schemas.GROUP_A, 1), experiment(1, schemas.GROUP_B, 2), experiment(2, schemas.GROUP_B, 3)],
    )
    ab = {r["experiment_group"]: r for r in rows(reports.ab_results(t))}
    assert ab[schemas.GROUP_A]["checkout_sessions"] == 1 and ab[schemas.GROUP_A]["purchase_sessions"] == 1
    assert ab[schemas.GROUP_B]["checkout_sessions"] == 1 and ab[schemas.GROUP_B]["purchase_sessions"] == 2
    assert ab[schemas.GROUP_B]["conversion_rate_pct"] == 200.0
    sig = rows(reports.ab_significance(t))[0]
    # the purchase without checkout is not a success of the test
    assert (sig["n_a"], sig["x_a"], sig["n_b"], sig["x_b"]) == (1, 1, 1, 1)
    assert sig["z_score"] is None  # pooled rate 1


def test_same_day_order_not_in_past_purchases(spark):
    t = make_tables(
        spark,
        users=[user(1)],
        sessions=[session(10, 1, d=0), session(11, 1, d=1), session(12, 1, d=5)],
        orders=[order(1, 1, 10, 5.0, d=0), order(2, 1, 11, 5.0, d=1), order(3, 1, 11, 5.0, d=1)],
    )
    got = {r["session_id"]: r["past_purchases_count"] for r in rows(history.past_purchases(t.sessions, t.orders))}
    assert got == {10: 0, 11: 1, 12: 3}


def test_exact_day_retention(spark):
    t = make_tables(
        spark,
        users=[user(1, signup=0), user(2, signup=0)],
        sessions=[session(10, 1, d=1), session(11, 1, d=7), session(12, 2, d=2)],
    )
    (got,) = rows(reports.retention_grid(t))
    assert (got["cohort_size"], got["d0_users"], got["d1_users"], got["d7_users"]) == (2, 0, 1, 1)


def test_segment_boundaries(spark):
    end = dt.date(2024, 1, 30)
    users = spark.createDataFrame(
        [(1, dt.date(2024, 1, 16)), (2, dt.date(2024, 1, 2)), (3, dt.date(2024, 1, 2)), (4, dt.date(2024, 1, 15))],
        "user_id long, signup_date date",
    )
    t = make_tables(
        spark,
        sessions=[session(20 + d, 2, d=d) for d in range(3)] + [session(30 + d, 3, d=d) for d in range(2)],
    )
    seg = {r["user_id"]: r["user_segment"] for r in entities.segment_users(users, t.sessions, end).collect()}
    assert seg == {1: "New User", 2: "Repeat User", 3: "Dormant User", 4: "Dormant User"}


def test_empty_string_filter_is_a_filter(spark):
    t = make_tables(
        spark,
        users=[user(1, city="C1")],
        sessions=[session(10, 1)],
        events=[event(10, 1, "App Open")],
        orders=[order(1, 1, 10, 9.0)],
    )
    assert rows(reports.business_kpis(t, city=""))[0]["total_revenue"] == 0.0
    assert rows(reports.business_kpis(t, city=None))[0]["total_revenue"] == 9.0


def test_risk_bands_are_strict(spark):
    df = spark.createDataFrame([(70.0,), (40.0,), (70.0001,), (40.0001,), (100.0,), (0.0,)], "r double")
    got = [(r["r"], r["b"], r["a"]) for r in df.select("r", ml.risk_band(F.col("r")).alias("b"), ml.risk_action(F.col("r")).alias("a")).collect()]
    assert got == [
        (70.0, "MEDIUM", "maintain"),
        (40.0, "LOW", "maintain"),
        (70.0001, "HIGH", "offer"),
        (40.0001, "MEDIUM", "maintain"),
        (100.0, "HIGH", "offer"),
        (0.0, "LOW", "maintain"),
    ]


def test_orphans_duplicates_nulls_reported(spark):
    t = make_tables(
        spark,
        users=[user(1), user(1)],
        sessions=[session(10, 1)],
        events=[event(10, 1, "Purchase"), event(99, 7, "Purchase")],
        orders=[order(1, 1, 10, 5.0), order(2, 1, 98, 7.0)],
    )
    t = t.__class__(
        users=t.users,
        sessions=t.sessions.unionByName(
            spark.createDataFrame(
                [(11, 1, 0, None, dt.date(2024, 1, 1), 0)],
                "session_id long, user_id long, session_duration long, device_type string, "
                "session_date date, discount_coupon_applied int",
            )
        ),
        events=t.events,
        orders=t.orders,
        experiments=t.experiments,
    )
    got = {(r["check_name"], r["table_name"], r["column_name"]): r["violations"] for r in audit.integrity_audit(t).collect()}
    assert got[("duplicate_key", "users", "user_id")] == 1
    assert got[("orphan_key", "events", "session_id")] == 1
    assert got[("orphan_key", "events", "user_id")] == 1
    assert got[("orphan_key", "orders", "session_id")] == 1
    assert got[("null_value", "sessions", "device_type")] == 1
    assert got[("orphan_key", "sessions", "user_id")] == 0
    # the SQL-pack KPIs count the orphan order, the query-layer KPIs only reach it through its user
    assert rows(reports.topline_kpis(t))[0]["total_revenue_usd"] == 12.0


def test_planted_ios_leakage_is_flagged_only_for_ios(spark):
    sessions, events = [], []
    sid = 0
    for device, carts, checkouts in [("iOS", 100, 40), ("Android", 100, 85), ("Web", 100, 80)]:
        for i in range(carts):
            sid += 1
            sessions.append(session(sid, sid, device=device))
            events.append(event(sid, sid, "Add To Cart"))
            if i < checkouts:
                events.append(event(sid, sid, "Checkout"))
    t = make_tables(spark, users=[user(i) for i in range(1, sid + 1)], sessions=sessions, events=events)
    flagged = {r["device_type"]: r["leakage_flag"] for r in reports.device_leakage(t, threshold_pts=20.0).collect()}
    assert flagged == {"iOS": True, "Android": False, "Web": False}


def test_chi_square_is_undefined_without_two_groups_and_outcomes(spark):
    empty = make_tables(spark, users=[user(1)])
    assert reports.ab_pvalue(empty).collect()[0]["p_value"] is None
    one_group = make_tables(
        spark, users=[user(1)], sessions=[session(10, 1)], events=[event(10, 1, "Checkout")],
        experiments=[experiment(1, schemas.GROUP_A)],
    )
    row = reports.ab_pvalue(one_group).collect()[0]
    assert row["p_value"] is None and row["dof"] == 0
