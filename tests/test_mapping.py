"""The mapping of raw events: nothing dropped, no two sessions merged."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from conftest import SF_SMALL
from tidemark.plans import registry
from tidemark.sources.driver_data import load_app_tables

T = dt.datetime(2024, 1, 3, 8)
EVENTS = [
    # event_id, ts, user_id, event_type, value, props
    (1, T, 2, "signup", 1.0, '{"k": 7}'),
    (2, T + dt.timedelta(days=1000), 1, "purchase", 10.125, '{"k": 5}'),  # day 1,002, once an id of user 2's
    (3, T + dt.timedelta(days=1000, seconds=9), 1, "purchase", 20.25, "{}"),
    (4, T, 3, "view", 2.0, '{"k": "x"}'),  # the session's first k is NULL
    (5, T + dt.timedelta(seconds=4), 3, "click", 2.0, '{"k": 1}'),
    (6, T, 999999, "purchase", 5.5, '{"k": 3}'),  # no such user
    (7, T - dt.timedelta(days=20), 1, "view", 1.0, '{"k": 2}'),  # before any signup
    (8, T, None, "purchase", 1.25, '{"k": 4}'),  # in no session
    (9, None, 1, "purchase", 2.5, '{"k": 4}'),
    (10, T, 5, None, None, None),
]
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(EVENTS, SCHEMA).write.parquet(str(path / "events.parquet"))
    for name in ("customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_sessions_of_two_users_stay_apart(spark, odd):
    sessions = {(r.user_id, str(r.session_date)): r for r in load_app_tables(spark, odd).sessions.collect()}
    assert len(sessions) == 6 and len({r.session_id for r in sessions.values()}) == 6
    assert sessions[1, "2026-09-29"].session_duration == 9 and sessions[2, "2024-01-03"].session_duration == 0
    assert (sessions[3, "2024-01-03"].device_type, sessions[3, "2024-01-03"].discount_coupon_applied) == (None, 0)


def test_no_event_is_dropped(spark, odd):
    tables = load_app_tables(spark, odd)
    assert tables.events.count() == len(EVENTS)
    assert tables.orders.count() == sum(e[3] == "purchase" and None not in e[1:3] for e in EVENTS)


def test_a_day_without_room_is_an_error(spark, odd):
    late = spark.createDataFrame([(1, dt.datetime(2300, 1, 1), 1, "view", 1.0, "{}")], SCHEMA)
    late.createOrReplaceTempView("late")
    from tidemark.operators import entities
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="no session key for day 2300-01-01"):
        late.select(entities.session_key(F.col("user_id"), F.to_date("ts"))).collect()


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_odd_events_match_the_oracle(spark, odd, key):
    con = duckdb.connect()
    for name in ("events", "customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{odd}/{name}.parquet/*.parquet'")
    df = registry.queries()[key](spark, odd)
    cursor = con.execute(registry.oracle_sql()[key])
    names = [d[0] for d in cursor.description]
    plain = lambda r: tuple((v is not None, round(v, 9) if isinstance(v, float) else v) for v in r)
    order = lambda rows: sorted(map(plain, rows), key=repr)
    assert order(tuple(r[n] for n in names) for r in df.collect()) == order(cursor.fetchall())
