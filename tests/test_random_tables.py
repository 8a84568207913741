"""Reports over randomly generated five-table inputs (with sessions without
events, orphan events and orders, users without sessions, users in two
experiment groups and duplicate experiment rows) against the oracle SQL run
by DuckDB directly on the same rows."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from helpers import make_tables
from tidemark.operators import audit, entities, history
from tidemark.plans import ml, oracle, reports
from tidemark.sources import schemas

D0 = dt.date(2024, 1, 1)


def random_rows(seed: int, hot_user: bool = False):
    """Random five-table rows; with ``hot_user`` user 1 holds most sessions,
    events and orders (the skew case)."""
    rnd = random.Random(seed)
    n_users = rnd.randint(5, 40)
    users = [
        (
            u,
            D0 + dt.timedelta(days=rnd.randint(0, 10)),
            rnd.choice(["C1", "C2", "C3"]),
            rnd.choice(["Meta", "Google", "Organic"]),
            rnd.choice([schemas.SEGMENT_NEW, schemas.SEGMENT_REPEAT, schemas.SEGMENT_DORMANT]),
        )
        for u in range(1, n_users + 1)
    ]
    sessions, events, orders = [], [], []
    sid, eid, oid = 100, 1, 1
    for u in range(1, n_users + 6):  # a few sessions of unknown users
        for _ in range(rnd.randint(60, 80) if hot_user and u == 1 else rnd.randint(0, 6)):
            sid += 1
            day = D0 + dt.timedelta(days=rnd.randint(0, 20))
            coupon = rnd.choice([0, 1, None])
            sessions.append((sid, u, rnd.randint(0, 900), rnd.choice(schemas.DEVICES), day, coupon))
            for _ in range(rnd.choice([0, 0, 1, 3, 6, 10])):  # some sessions have no events
                ts = dt.datetime.combine(day, dt.time()) + dt.timedelta(seconds=rnd.randint(0, 3600))
                events.append((eid, u, sid, rnd.choice(schemas.STAGES), None, ts))
                eid += 1
            for _ in range(rnd.choice([0, 0, 1, 2])):  # sessions with two orders
                orders.append((oid, u, sid, Decimal(rnd.randint(500, 50000)) / 100, rnd.choice(schemas.CATEGORIES), day))
                oid += 1
    for _ in range(3):  # orphan events and orders
        ts = dt.datetime.combine(D0, dt.time())
        events.append((eid, 999, 99999, rnd.choice(schemas.STAGES), None, ts))
        eid += 1
        orders.append((oid, rnd.choice([1, 999]), 99998, Decimal(10), "Fashion", D0))
        oid += 1
    experiments = []
    xid = 1
    for u in range(1, n_users + 3):
        groups = rnd.choice([[schemas.GROUP_A], [schemas.GROUP_B], [schemas.GROUP_A, schemas.GROUP_B], [schemas.GROUP_B, schemas.GROUP_B], []])
        for g in groups:
            experiments.append((xid, u, g, schemas.EXPERIMENT_FEATURE, D0))
            xid += 1
    return dict(users=users, sessions=sessions, events=events, orders=orders, experiments=experiments)


def duck_for(rows) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name, schema in schemas.TABLE_SCHEMAS.items():
        df = pd.DataFrame(rows[name], columns=schema.fieldNames())
        con.register(f"_{name}", df)
        casts = {
            "LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE", "DecimalType(10,2)": "DECIMAL(10,2)", "StringType()": "VARCHAR",
            "DateType()": "DATE", "TimestampNTZType()": "TIMESTAMP",
        }
        cols = ", ".join(f'CAST("{f.name}" AS {casts[repr(f.dataType)]}) AS "{f.name}"' for f in schema.fields)
        con.execute(f"CREATE TABLE app_{name} AS SELECT {cols} FROM _{name}")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, pd.Timestamp):
        return v.date()
    return v


def same(spark_df, con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    duck = sorted((tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    rows = spark_df.collect()
    assert sorted(spark_df.columns) == sorted(cols)
    got = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in rows), key=repr)
    assert got == duck


CASES = {
    "funnel_by_device": (reports.funnel_by_device, oracle.funnel_by_device),
    "funnel_sessions": (reports.funnel_sessions, oracle.funnel_sessions),
    "funnel_sessions_web": (lambda t: reports.funnel_sessions(t, device_type="Web"), lambda: oracle.funnel_sessions("Web")),
    "funnel_sessions_meta": (lambda t: reports.funnel_sessions(t, channel="Meta"), lambda: oracle.funnel_sessions(None, "Meta")),
    "retention_by_channel": (reports.retention_by_channel, oracle.retention_by_channel),
    "retention_grid": (reports.retention_grid, oracle.retention_grid),
    "retention_validation": (reports.retention_validation, oracle.retention_validation),
    "acquisition_share": (reports.acquisition_share, oracle.acquisition_share),
    "business_kpis": (reports.business_kpis, oracle.business_kpis),
    "business_kpis_c2": (lambda t: reports.business_kpis(t, city="C2"), lambda: oracle.business_kpis("C2")),
    "topline_kpis": (reports.topline_kpis, oracle.topline_kpis),
    "segment_performance": (reports.segment_performance, oracle.segment_performance),
    "segment_by_channel": (reports.segment_by_channel, oracle.segment_by_channel),
    "ab_results": (reports.ab_results, oracle.ab_results),
    "ab_raw": (reports.ab_raw, oracle.ab_raw),
    "ab_lift": (reports.ab_lift, oracle.ab_lift),
    "ab_significance": (reports.ab_significance, oracle.ab_significance),
    "device_checkout": (reports.device_checkout, oracle.device_checkout),
    "device_leakage": (reports.device_leakage, oracle.device_leakage),
    "past_purchases": (lambda t: history.past_purchases(t.sessions, t.orders), oracle.past_purchases),
    "cart_features": (ml.cart_features, oracle.cart_features),
    "label_distribution": (lambda t: ml.label_distribution(ml.cart_features(t)), oracle.label_distribution),
    "stratified_split": (
        lambda t: ml.stratified_split(ml.cart_features(t), bucket_hex_digits=1).select("session_id", "abandoned", "split"),
        oracle.stratified_split,
    ),
    "integrity_audit": (audit.integrity_audit, oracle.integrity_audit),
    "table_counts": (reports.table_counts, oracle.table_counts),
    "user_active_days": (lambda t: entities.active_days(t.sessions), oracle.user_active_days),
    "briefing_context": (reports.briefing_context, oracle.briefing_context),
}


@pytest.fixture(scope="module", params=[(1, False), (2, False), (3, False), (4, True)], ids=["r1", "r2", "r3", "hot"])
def world(request, spark):
    seed, hot = request.param
    rows = random_rows(seed, hot_user=hot)
    return make_tables(spark, **rows), duck_for(rows)


@pytest.mark.parametrize("case", sorted(CASES))
def test_random_tables_match_oracle(world, case, monkeypatch):
    tables, con = world
    build, sql = CASES[case]
    monkeypatch.setattr(oracle, "oracle_cte", lambda: "WITH _none AS (SELECT 1)")
    same(build(tables), con, sql())
