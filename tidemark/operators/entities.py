"""Derived-entity jobs: sessions, active days, segments,
experiment assignment and orders, all built from raw events as DataFrame
aggregations.

Every aggregation here is algebraic (min / max / min_by / count / sum), so
Spark combines map-side before the shuffle: a user or a session holding a
third of all events costs one partial row per input partition, not a hot task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import schemas


#: Days from 1970-01-01 that a session key has room for (to the year 2243).
SESSION_DAYS = 100_000


def session_key(user_id: Column, day: Column) -> Column:
    """Session id of the one-session-per-(user, day) rule: the user and the day
    since 1970-01-01 in disjoint digits, so no two sessions share an id. A day
    outside the range raises an error; NULL for no user or no day."""
    number = F.unix_date(day).cast("bigint")
    fits = number.between(0, SESSION_DAYS - 1)
    key = user_id.cast("bigint") * F.lit(SESSION_DAYS) + number
    return F.when(fits | number.isNull(), key).otherwise(
        F.raise_error(F.concat(F.lit("no session key for day "), day.cast("string"))).cast("bigint")
    )


def sessionize(events: DataFrame, first_event: dict[str, str], extra_aggs: list[Column]) -> DataFrame:
    """I1 + I2: one row per session, in one hash aggregation of ``events``
    (session_id, user_id, timestamp, event_date, event_id and whatever the
    further aggregates read).

    Events without a session (no user or no day) belong to none. The duration
    is the whole seconds between the first and the last event. ``first_event``
    maps output names to *numeric* columns, whose value at the lowest event_id
    is kept (also if NULL): a string there would force Spark to sort the raw
    events. What derives from them is derived after the aggregation.
    ``extra_aggs`` are computed in the same pass."""
    return (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.min("user_id").alias("user_id"),
            F.min("event_date").alias("session_date"),
            F.timestamp_diff("SECOND", F.min("timestamp"), F.max("timestamp")).alias("session_duration"),
            *[F.min_by(column, "event_id").alias(name) for name, column in first_event.items()],
            *extra_aggs,
        )
    )


def active_days(sessions: DataFrame) -> DataFrame:
    """I3: distinct session dates per user → (user_id, active_days)."""
    return sessions.groupBy("user_id").agg(F.count_distinct("session_date").alias("active_days"))


def segment_users(
    users: DataFrame,
    sessions: DataFrame,
    end_date: dt.date | Column,
    new_window_days: int = schemas.NEW_USER_WINDOW_DAYS,
    repeat_min_days: int = schemas.REPEAT_MIN_ACTIVE_DAYS,
) -> DataFrame:
    """I4: New if ``signup_date >= end_date - new_window_days``; else Repeat
    with at least ``repeat_min_days`` active days; else Dormant. First match
    wins, so a New user's activity is ignored. Users without sessions have 0
    active days."""
    cutoff = F.date_sub(end_date if isinstance(end_date, Column) else F.lit(end_date), new_window_days)
    days = active_days(sessions)
    n_days = F.coalesce(F.col("active_days"), F.lit(0))
    segment = (
        F.when(F.col("signup_date") >= cutoff, F.lit(schemas.SEGMENT_NEW))
        .when(n_days >= repeat_min_days, F.lit(schemas.SEGMENT_REPEAT))
        .otherwise(F.lit(schemas.SEGMENT_DORMANT))
    )
    return users.join(days, "user_id", "left").withColumn("user_segment", segment).drop("active_days")


def assign_experiments(users: DataFrame, feature_name: str, launch_date: dt.date) -> DataFrame:
    """I5: one experiment row per user; even user_id → Group B, odd → Group A."""
    group = F.when(F.col("user_id") % 2 == 0, F.lit(schemas.GROUP_B)).otherwise(F.lit(schemas.GROUP_A))
    return users.select(
        F.col("user_id").alias("experiment_id"),
        F.col("user_id"),
        group.alias("experiment_group"),
        F.lit(feature_name).alias("feature_name"),
        F.lit(launch_date).alias("launch_date"),
    )


def orders_from_events(
    events: DataFrame,
    *,
    amount: Column,
    category: Column,
    day_col: str = "event_date",
    purchase_type: str = "Purchase",
) -> DataFrame:
    """I6: one order per Purchase event; the order date is the session's day."""
    return events.filter(F.col("event_type") == F.lit(purchase_type)).select(
        F.col("event_id").alias("order_id"),
        "user_id",
        "session_id",
        amount.alias("amount"),
        category.alias("category"),
        F.col(day_col).alias("order_date"),
    )
