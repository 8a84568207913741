"""Funnels over any range of days from stored daily bitmaps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import day, event, make_tables, session
from tidemark.operators import bitmaps
from tidemark.plans import reports
from tidemark.plans.mart import session_mart
from tidemark.sources.driver_data import load_app_tables
from tidemark.sources.io import AppTables, materialize


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("first,last", [(0, 400), (0, 0), (3, 9), (5, 4), (7, 30)])
def test_any_range_equals_the_direct_count(spark, tmp_path, first, last):
    t = load_app_tables(spark, SF_SMALL)
    stored = materialize(bitmaps.daily_stage_bitmaps(session_mart(t)), str(tmp_path / "daily"))
    inside = F.col("session_date").between(F.lit(day(first)), F.lit(day(last)))
    some = AppTables(t.users, t.sessions.filter(inside), t.events, t.orders, t.experiments)
    assert rows(reports.funnel_by_device_between(stored, day(first), day(last))) == rows(reports.funnel_by_device(some))


def test_large_and_negative_ids_and_users_who_come_back(spark):
    ids = [0, 1, 32_767, 32_768, 32_769, -1, -40_000, 2**40]
    sessions = [session(i * 10 + d, u, d, ["iOS", "Web"][i % 2]) for i, u in enumerate(ids) for d in range(3)]
    events = [event(i * 10 + d, u, "Search", d) for i, u in enumerate(ids) for d in range(3) if d != 1]
    t = make_tables(spark, sessions=sessions, events=events)
    daily = bitmaps.daily_stage_bitmaps(session_mart(t))
    assert rows(reports.funnel_by_device_between(daily, day(0), day(2))) == rows(reports.funnel_by_device(t))
    got = {r.device_type: r.search_users for r in reports.funnel_by_device_between(daily, day(0), day(2)).collect()}
    assert got == {"iOS": 4, "Web": 4}
    assert {r.search_users for r in reports.funnel_by_device_between(daily, day(1), day(1)).collect()} == {0}


def test_weekly_from_stored_bitmaps(spark, tmp_path):
    t = load_app_tables(spark, SF_SMALL)
    stored = materialize(bitmaps.daily_stage_bitmaps(session_mart(t)), str(tmp_path / "daily"))
    weekly = rows(reports.funnel_by_device_weekly(t, stored))
    assert weekly == rows(reports.funnel_by_device_weekly(t)) and len(weekly) > 3
