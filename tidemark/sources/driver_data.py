"""Mapping of the provided test tables (``events``, ``customer``, ``nation``)
onto the five-table app model.

Rules (``k`` = integer ``$.k`` of ``events.props``; ``d0`` = 2024-01-01;
``day`` = date of ``ts``):

* users       customer ⋈ nation; user_id = c_custkey, signup = d0 + custkey % 20,
              city = n_name, channel = c_mktsegment, segment by the I4 rule
              with the last day of the events as its end.
* events      every raw event, whoever its user; session_id from user and day;
              event types mapped below.
* sessions    one per (user, day); device / coupon from k of the first event.
* orders      one per Purchase event of a session (it has a user and a time);
              amount = value; category = k % 5.
* experiments one per user, by user_id parity.

No event is left out: those of unknown users or from before a signup stay, and
reports that are about known users join the users.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import entities, flags
from tidemark.plans import mart
from tidemark.sources import schemas
from tidemark.sources.io import AppTables

ORIGIN = dt.date(2024, 1, 1)
SIGNUP_SPREAD_DAYS = 20


#: The raw columns that the mapping reads (fixed values). They are declared, so
#: no file is opened to infer them.
RAW_SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _signup_date(user_id: Column) -> Column:
    return F.date_add(F.lit(ORIGIN), (user_id % SIGNUP_SPREAD_DAYS).cast("int"))


def _pick(index: Column, values: list[str]) -> Column:
    expr = None
    for i, value in enumerate(values):
        expr = (F.when(index == i, F.lit(value)) if expr is None else expr.when(index == i, F.lit(value)))
    return expr


def _event_type(raw: Column, k: Column) -> Column:
    return (
        F.when(raw == "signup", F.lit("App Open"))
        .when((raw == "view") & (k < 50), F.lit("Search"))
        .when(raw == "view", F.lit("View Product"))
        .when(raw == "click", F.lit("Add To Cart"))
        .when(raw == "error", F.lit("Checkout"))
        .when(raw == "purchase", F.lit("Purchase"))
    )


def base_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without their segment (the segment needs sessions)."""
    customer = read_raw(spark, sf_dir, "customer")
    nation = read_raw(spark, sf_dir, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").cast("bigint").alias("user_id"),
        _signup_date(F.col("c_custkey")).alias("signup_date"),
        F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("acquisition_channel"),
    )


def mapped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw events with the session key, the app event type and the helper
    columns ``k``, ``value`` and ``event_date``."""
    day = F.to_date(F.col("ts"))
    k = F.get_json_object(F.col("props"), "$.k").try_cast("int")
    raw = read_raw(spark, sf_dir, "events").select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("raw_type"),
        F.col("value"),
        k.alias("k"),
        day.alias("event_date"),
    )
    return raw.select(
        "event_id",
        "user_id",
        entities.session_key(F.col("user_id"), F.col("event_date")).alias("session_id"),
        _event_type(F.col("raw_type"), F.col("k")).alias("event_type"),
        F.lit(None).cast("string").alias("feature_name"),
        "timestamp",
        "event_date",
        "k",
        "value",
    )


def last_event_date(events: DataFrame) -> Column:
    """The last day of the events, as a scalar subquery over their time alone."""
    return events.agg(F.max("event_date")).scalar()


def build_session_rollup(events: DataFrame) -> DataFrame:
    """Sessions, their stage counts and order totals from one aggregation."""
    is_order = F.coalesce(F.col("event_type") == F.lit("Purchase"), F.lit(False))
    rollup = entities.sessionize(
        events,
        first_event={"first_k": "k"},
        extra_aggs=[*flags.stage_count_aggs(), *mart.order_aggs(F.col("value"), is_order)],
    )
    k = F.col("first_k")
    return rollup.select(
        "*",
        _pick(k % 3, schemas.DEVICES).alias("device_type"),
        F.when(k % 5 == 0, F.lit(1)).otherwise(F.lit(0)).alias("discount_coupon_applied"),
    ).drop("first_k")


def build_sessions(events: DataFrame) -> DataFrame:
    return build_session_rollup(events).select(*schemas.SESSIONS.fieldNames())


def build_orders(events: DataFrame) -> DataFrame:
    return entities.orders_from_events(
        events.filter(F.col("session_id").isNotNull()), amount=F.col("value"), category=_pick(F.col("k") % 5, schemas.CATEGORIES)
    )


class MappedTables(AppTables):
    """The five app tables over the test data in ``sf_dir``; each plan is built
    when it is first asked for, so a report pays for the tables it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str, end_date: dt.date | None = None):
        self.__dict__ |= {"memo": {}, "_spark": spark, "_sf_dir": sf_dir, "_end_date": end_date}

    @cached_property
    def _base_users(self) -> DataFrame:
        return base_users(self._spark, self._sf_dir)

    @cached_property
    def _mapped_events(self) -> DataFrame:
        return mapped_events(self._spark, self._sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        end = self._end_date or last_event_date(self._mapped_events)
        return entities.segment_users(self._base_users, self.sessions, end).select(*schemas.USERS.fieldNames())

    @cached_property
    def sessions(self) -> DataFrame:
        return self.session_rollup.select(*schemas.SESSIONS.fieldNames())

    @cached_property
    def events(self) -> DataFrame:
        return self._mapped_events.select(*schemas.EVENTS.fieldNames())

    @cached_property
    def orders(self) -> DataFrame:
        return build_orders(self._mapped_events)

    @cached_property
    def experiments(self) -> DataFrame:
        return entities.assign_experiments(self._base_users, schemas.EXPERIMENT_FEATURE, ORIGIN)

    @cached_property
    def session_rollup(self) -> DataFrame:
        rollup = build_session_rollup(self._mapped_events)
        return rollup.select(*schemas.SESSIONS.fieldNames(), *flags.COUNT_COLS, *mart.ORDER_COLS)


def load_app_tables(spark: SparkSession, sf_dir: str, end_date: dt.date | None = None) -> AppTables:
    """The five app tables over the test data in ``sf_dir`` (lazy plans).
    ``end_date`` closes the New-user window; by default it is the last day of
    the events."""
    return MappedTables(spark, sf_dir, end_date)


# --- the same mapping as DuckDB SQL, for the oracle ------------------------


def _sql_pick(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def oracle_cte() -> str:
    """A ``WITH`` prefix defining app_users, app_events, app_sessions,
    app_orders and app_experiments over the driver's views in DuckDB."""
    d0 = f"DATE '{ORIGIN.isoformat()}'"
    return f"""
WITH app_users_base AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS user_id,
         {d0} + CAST(c.c_custkey % {SIGNUP_SPREAD_DAYS} AS INTEGER) AS signup_date,
         n.n_name AS city, c.c_mktsegment AS acquisition_channel
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
),
raw_events AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, ts, event_type AS raw_type,
         value, TRY_CAST(props->>'$.k' AS INTEGER) AS k, CAST(ts AS DATE) AS event_date
  FROM events
),
app_events AS (
  SELECT event_id, user_id,
         user_id * {entities.SESSION_DAYS} + date_diff('day', DATE '1970-01-01', event_date) AS session_id,
         CASE WHEN raw_type = 'signup' THEN 'App Open'
              WHEN raw_type = 'view' AND k < 50 THEN 'Search'
              WHEN raw_type = 'view' THEN 'View Product'
              WHEN raw_type = 'click' THEN 'Add To Cart'
              WHEN raw_type = 'error' THEN 'Checkout'
              WHEN raw_type = 'purchase' THEN 'Purchase' END AS event_type,
         CAST(NULL AS VARCHAR) AS feature_name, ts AS "timestamp", event_date, k, value
  FROM raw_events
),
app_sessions AS (
  SELECT session_id, MIN(user_id) AS user_id,
         date_sub('second', MIN("timestamp"), MAX("timestamp")) AS session_duration,
         {_sql_pick('arg_min_null(k, event_id) % 3', schemas.DEVICES)} AS device_type,
         MIN(event_date) AS session_date,
         CASE WHEN arg_min_null(k, event_id) % 5 = 0 THEN 1 ELSE 0 END AS discount_coupon_applied
  FROM app_events WHERE session_id IS NOT NULL GROUP BY session_id
),
app_users AS (
  SELECT u.user_id, u.signup_date, u.city, u.acquisition_channel,
         CASE WHEN u.signup_date >= (SELECT MAX(event_date) FROM raw_events) - {schemas.NEW_USER_WINDOW_DAYS} THEN '{schemas.SEGMENT_NEW}'
              WHEN COALESCE(a.active_days, 0) >= {schemas.REPEAT_MIN_ACTIVE_DAYS} THEN '{schemas.SEGMENT_REPEAT}'
              ELSE '{schemas.SEGMENT_DORMANT}' END AS user_segment
  FROM app_users_base u
  LEFT JOIN (SELECT user_id, COUNT(DISTINCT session_date) AS active_days FROM app_sessions GROUP BY user_id) a
    ON u.user_id = a.user_id
),
app_orders AS (
  SELECT event_id AS order_id, user_id, session_id, value AS amount,
         {_sql_pick('k % 5', schemas.CATEGORIES)} AS category, event_date AS order_date
  FROM app_events WHERE event_type = 'Purchase' AND session_id IS NOT NULL
),
app_experiments AS (
  SELECT user_id AS experiment_id, user_id,
         CASE WHEN user_id % 2 = 0 THEN '{schemas.GROUP_B}' ELSE '{schemas.GROUP_A}' END AS experiment_group,
         '{schemas.EXPERIMENT_FEATURE}' AS feature_name, {d0} AS launch_date
  FROM app_users_base
)"""
