"""The session mart: one row per session with its attributes, stage counts,
stage flags and order totals (SURVEY 7.2).

Tables that are mapped from raw events bring a rollup: one hash aggregation of
the events gives the sessions' attributes, stage counts, and order counts and
amounts together, so the mart is one scan and one shuffle. Tables read from a
store have sessions, events and orders apart; there the counts and totals are
aggregated by ``session_id`` and joined to the sessions on it.

The user-device facts sum the mart per user and device once. The funnels, the
KPIs, the segments, the experiment and the devices' checkout all add these up
further (by device, by user, over all), so a pack of them scans the mart once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import money_units
from tidemark.operators import flags
from tidemark.sources import schemas
from tidemark.sources.io import AppTables

_COUNT_COLS = flags.COUNT_COLS
#: Order rows of a session, those with an amount, and their amount in units.
ORDER_COLS = ["n_orders", "n_amounts", "order_units"]


def order_aggs(amount: Column, is_order: Column) -> list[Column]:
    return [
        F.count_if(is_order).alias("n_orders"),
        F.count(F.when(is_order, amount)).alias("n_amounts"),
        F.sum(F.when(is_order, money_units(amount))).alias("order_units"),
    ]


def order_facts(orders: DataFrame) -> DataFrame:
    """Order totals per session."""
    return orders.groupBy("session_id").agg(*order_aggs(F.col("amount"), F.lit(True)))


def session_mart(tables: AppTables) -> DataFrame:
    """sessions ⟕ stage counts ⟕ order facts.

    Columns: the session's own columns, ``n_<stage>`` and ``n_events``
    (0 for sessions without events), ``has_<stage>`` flags (0/1), and
    ``ORDER_COLS`` (counts 0 and units NULL when there are none).
    The plan is built once per ``AppTables`` and shared by its reports.
    """
    if "session_mart" not in tables.memo:
        tables.memo["session_mart"] = _build_mart(tables)
    return tables.memo["session_mart"]


def _build_mart(tables: AppTables) -> DataFrame:
    if tables.session_rollup is not None:
        counted = tables.session_rollup
    else:
        counted = tables.sessions.join(flags.stage_counts(tables.events, "session_id"), "session_id", "left").join(
            order_facts(tables.orders), "session_id", "left"
        )
    return counted.fillna(0, subset=[*_COUNT_COLS, "n_orders", "n_amounts"]).select(
        "*", *[flags.has_flag(k).alias(flags.has_col(k)) for k in schemas.STAGE_KEYS]
    )


def s_col(stage_key: str) -> str:
    return f"s_{stage_key}"


#: Measures of the user-device facts, each a sum over the sessions of the mart:
#: sessions, those with events, those that reached each stage (``s_<stage>``),
#: those with both a checkout and a purchase, those with an order; and the
#: amounts.
STAGE_SESSIONS = [s_col(k) for k in schemas.STAGE_KEYS]
FACTS = ["n_sessions", "n_eventful", *STAGE_SESSIONS, "s_checkout_purchase", "n_order_sessions", "n_amounts", "order_units"]


def user_device_facts(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """One row per user and device of the mart with the ``FACTS``. Built once
    per ``AppTables`` over its own mart and shared by its reports."""
    if mart is not None and mart is not tables.memo.get("session_mart"):
        return _build_facts(mart)
    if "user_device_facts" not in tables.memo:
        tables.memo["user_device_facts"] = _build_facts(session_mart(tables))
    return tables.memo["user_device_facts"]


def _build_facts(mart: DataFrame) -> DataFrame:
    both = F.col(flags.has_col("checkout")) * F.col(flags.has_col("purchase"))
    return mart.groupBy("user_id", "device_type").agg(
        F.count("session_id").alias("n_sessions"),
        F.count_if(F.col("n_events") > 0).alias("n_eventful"),
        *[F.sum(flags.has_col(k)).alias(s_col(k)) for k in schemas.STAGE_KEYS],
        F.sum(both).alias("s_checkout_purchase"),
        F.count_if(F.col("n_orders") > 0).alias("n_order_sessions"),
        F.sum("n_amounts").alias("n_amounts"),
        F.sum("order_units").alias("order_units"),
    )
