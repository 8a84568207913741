"""Hand-made app tables for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tidemark.sources import schemas
from tidemark.sources.io import AppTables

D = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return D + dt.timedelta(days=n)


def ts(n_day: int, seconds: int = 0) -> dt.datetime:
    return dt.datetime.combine(day(n_day), dt.time()) + dt.timedelta(seconds=seconds)


def make_tables(spark, users=(), sessions=(), events=(), orders=(), experiments=()) -> AppTables:
    def frame(name, rows):
        return spark.createDataFrame(list(rows), schemas.TABLE_SCHEMAS[name])

    return AppTables(
        users=frame("users", users),
        sessions=frame("sessions", sessions),
        events=frame("events", events),
        orders=frame("orders", orders),
        experiments=frame("experiments", experiments),
    )


def user(uid, signup=0, city="C1", channel="X", segment="New User"):
    return (uid, day(signup), city, channel, segment)


def session(sid, uid, d=0, device="iOS", duration=10, coupon=0):
    return (sid, uid, duration, device, day(d), coupon)


_EID = [1000]


def event(sid, uid, etype, d=0, seconds=0, eid=None):
    if eid is None:
        _EID[0] += 1
        eid = _EID[0]
    return (eid, uid, sid, etype, None, ts(d, seconds))


def order(oid, uid, sid, amount, d=0, category="Fashion"):
    return (oid, uid, sid, None if amount is None else Decimal(str(amount)), category, day(d))


def experiment(uid, group, eid=None):
    return (eid if eid is not None else uid, uid, group, schemas.EXPERIMENT_FEATURE, D)
