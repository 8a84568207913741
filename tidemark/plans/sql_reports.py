"""The SQL-text path: the report pack and the filtered KPI query as Spark SQL
over temp views, with filter values passed as bound named parameters
(``spark.sql(text, args=...)``), never formatted into the text.

Only view *names* are substituted into the text (a per-call unique prefix, so
concurrent callers do not clobber each other's views). The statements read the
users and the session mart; none goes back to the events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.functions import UNITS
from tidemark.plans.mart import session_mart
from tidemark.sources import schemas
from tidemark.sources.io import AppTables

KEYS = schemas.STAGE_KEYS


def _pct2(a: str, b: str) -> str:
    d = f"NULLIF(CAST({b} AS BIGINT), 0)"
    return f"(((20000 * CAST({a} AS BIGINT) + {d}) div (2 * {d})) / 100.0D)"


def _spct2(a: str, b: str) -> str:
    return f"(SIGN({a}) * {_pct2(f'ABS({a})', b)})"


def _views(tables: AppTables) -> dict[str, str]:
    prefix = f"tm_{uuid.uuid4().hex[:12]}_"
    views = {"users": tables.users, "sessions": tables.sessions, "mart": session_mart(tables)}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return {name: prefix + name for name in views}


def funnel_by_device_sql(tables: AppTables) -> DataFrame:
    v = _views(tables)
    spark = tables.users.sparkSession
    user_max = ", ".join(f"MAX(has_{k}) AS {k}" for k in KEYS)
    dev_sum = ", ".join(f"CAST(SUM({k}) AS BIGINT) AS {k}" for k in KEYS)
    cols = ["device_type", "app_open AS app_open_users"]
    for prev, cur in zip(KEYS, KEYS[1:]):
        cols += [
            f"{cur} AS {cur}_users",
            f"{_pct2(cur, prev)} AS {cur}_step_conv_pct",
            f"{_spct2(f'({prev} - {cur})', prev)} AS {cur}_step_drop_pct",
        ]
    cols.append(f"{_pct2('purchase', 'app_open')} AS overall_conversion_pct")
    return spark.sql(f"""
WITH user_flags AS (SELECT device_type, user_id, {user_max} FROM {v['mart']} GROUP BY device_type, user_id),
per_device AS (SELECT device_type, {dev_sum} FROM user_flags GROUP BY device_type)
SELECT {', '.join(cols)} FROM per_device""")


def retention_grid_sql(tables: AppTables) -> DataFrame:
    v = _views(tables)
    return tables.users.sparkSession.sql(f"""
WITH came_back AS (
  SELECT DISTINCT u.acquisition_channel, u.user_id, datediff(s.session_date, u.signup_date) AS age
  FROM {v['sessions']} s JOIN {v['users']} u ON s.user_id = u.user_id
  WHERE datediff(s.session_date, u.signup_date) IN (0, 1, 7)
),
tally AS (
  SELECT acquisition_channel, COUNT(user_id) AS cohort, 0L AS d0, 0L AS d1, 0L AS d7
  FROM {v['users']} GROUP BY acquisition_channel
  UNION ALL
  SELECT acquisition_channel, 0L, COUNT_IF(age = 0), COUNT_IF(age = 1), COUNT_IF(age = 7)
  FROM came_back GROUP BY acquisition_channel
),
grid AS (
  SELECT acquisition_channel, SUM(cohort) AS cohort_size, SUM(d0) AS d0_users, SUM(d1) AS d1_users, SUM(d7) AS d7_users
  FROM tally GROUP BY acquisition_channel
)
SELECT acquisition_channel, cohort_size, d0_users,
  d1_users, {_pct2('d1_users', 'cohort_size')} AS d1_retention_pct,
  d7_users, {_pct2('d7_users', 'cohort_size')} AS d7_retention_pct
FROM grid""")


def _money(units: str, count: str | None = None) -> str:
    """Units, or their mean, half-up to cents in decimal arithmetic."""
    n, d = f"CAST({units} AS DECIMAL(28,0))", f"CAST({UNITS} AS DECIMAL(28,0))"
    if count is not None:
        d = f"CAST(NULLIF({count}, 0) * {UNITS} AS DECIMAL(28,0))"
    x, y = f"(ABS({n}) * 200 + {d})", f"({d} * 2)"
    return f"(CAST(SIGN({n}) AS DOUBLE) * (CAST(({x} - {x} % {y}) / {y} AS DOUBLE) / 100.0D))"


_SUMS = """
  SUM({one}) AS total_sessions, SUM({cart}) AS cart_sessions, SUM({purchase}) AS purchase_sessions,
  SUM({orders}) AS total_orders, SUM({amounts}) AS n_amounts, SUM({units}) AS units"""
_PER_SESSION = _SUMS.format(
    one="1", cart="has_add_to_cart", purchase="has_purchase", orders="IF(n_orders > 0, 1, 0)", amounts="n_amounts", units="order_units"
)
_AGAIN = _SUMS.format(
    one="total_sessions", cart="cart_sessions", purchase="purchase_sessions", orders="total_orders", amounts="n_amounts", units="units"
)


def topline_kpis_sql(tables: AppTables) -> DataFrame:
    v = _views(tables)
    return tables.users.sparkSession.sql(f"""
WITH card AS (SELECT {_PER_SESSION} FROM {v['mart']})
SELECT {_money('units')} AS total_revenue_usd, {_money('units', 'n_amounts')} AS average_order_value_usd,
  {_pct2('COALESCE(total_orders, 0)', 'total_sessions')} AS overall_conversion_rate_pct,
  {_spct2('(cart_sessions - purchase_sessions)', 'cart_sessions')} AS cart_abandonment_rate_pct
FROM card""")


def business_kpis_sql(tables: AppTables, city: str | None = None, channel: str | None = None) -> DataFrame:
    """The query layer's KPI card with ``(col = :p OR :p IS NULL)`` filters;
    the values are bound parameters, so a NULL folds the predicate away."""
    v = _views(tables)
    wanted = "(u.city = :city OR :city IS NULL) AND (u.acquisition_channel = :channel OR :channel IS NULL)"
    text = f"""
WITH per_user AS (SELECT user_id, {_PER_SESSION} FROM {v['mart']} GROUP BY user_id),
card AS (SELECT {_AGAIN} FROM per_user p JOIN {v['users']} u ON p.user_id = u.user_id WHERE {wanted}),
filled AS (
  SELECT GREATEST(total_sessions, 1) AS total_sessions, GREATEST(cart_sessions, 1) AS carts,
         COALESCE(purchase_sessions, 0) AS purchases, COALESCE(total_orders, 0) AS total_orders, n_amounts, units
  FROM card
)
SELECT COALESCE({_money('units')}, 0.0D) AS total_revenue, COALESCE({_money('units', 'n_amounts')}, 0.0D) AS avg_order_value,
  {_pct2('total_orders', 'total_sessions')} AS conversion_rate, {_spct2('(carts - purchases)', 'carts')} AS abandonment_rate,
  CAST(total_orders AS BIGINT) AS total_orders, CAST(total_sessions AS BIGINT) AS total_sessions
FROM filled"""
    return tables.users.sparkSession.sql(text, args={"city": city, "channel": channel})
