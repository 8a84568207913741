"""Independent DuckDB SQL for every deterministic report key.

Each statement starts from the driver's raw views (through
``driver_data.oracle_cte``) and uses a formulation deliberately different from
the Spark plans — distinct (entity, event type) rows counted with ``FILTER``,
``EXISTS`` for retention days, a stage dimension left-joined for the funnel,
an inequality join for prior orders, window ``LAG`` for step rates — so it
checks them rather than restating them. Integer sums are cast to
BIGINT (DuckDB sums integers to HUGEINT); rounded rates use the same exact
half-up rule as ``tidemark.functions.pct2``.
"""

from __future__ import annotations

from tidemark.functions import UNITS
from tidemark.sources import schemas
from tidemark.sources.driver_data import oracle_cte

STAGES = schemas.STAGES
KEYS = schemas.STAGE_KEYS


def rr(num: str, den: str, scale: int = 1) -> str:
    """round(scale * num / den, 2), exact half-up, NULL on den = 0."""
    d = f"NULLIF(CAST({den} AS BIGINT), 0)"
    return f"((({200 * scale} * CAST({num} AS BIGINT) + {d}) // (2 * {d})) / 100.0)"


def pct2(num: str, den: str) -> str:
    return rr(num, den, 100)


def spct2(num: str, den: str) -> str:
    return f"(SIGN({num}) * {pct2(f'ABS({num})', den)})"


def _q(body: str) -> str:
    return oracle_cte() + "\n" + body


def _stage_counts(source: str, key: str, group: str | None = None) -> str:
    """``COUNT(key) FILTER (WHERE event_type = stage)`` for the six stages over
    a relation of distinct (group, key, event_type) rows."""
    return ",\n    ".join(f"COUNT({key}) FILTER (WHERE event_type = '{s}') AS {k}" for s, k in zip(STAGES, KEYS))


def funnel_by_device() -> str:
    cols = ["device_type", "app_open AS app_open_users"]
    for prev, cur in zip(KEYS, KEYS[1:]):
        cols += [
            f"{cur} AS {cur}_users",
            f"{pct2(cur, prev)} AS {cur}_step_conv_pct",
            f"{spct2(f'({prev} - {cur})', prev)} AS {cur}_step_drop_pct",
        ]
    cols.append(f"{pct2('purchase', 'app_open')} AS overall_conversion_pct")
    return _q(f"""
, reached AS (
  SELECT DISTINCT s.device_type, s.user_id, e.event_type
  FROM app_sessions s LEFT JOIN app_events e ON e.session_id = s.session_id
),
per_device AS (
  SELECT device_type,
    {_stage_counts('reached', 'user_id')}
  FROM reached GROUP BY device_type
)
SELECT {', '.join(cols)} FROM per_device""")


def funnel_by_device_weekly() -> str:
    cols = ["week", "device_type", "app_open AS app_open_users"]
    for prev, cur in zip(KEYS, KEYS[1:]):
        cols += [
            f"{cur} AS {cur}_users",
            f"{pct2(cur, prev)} AS {cur}_step_conv_pct",
            f"{spct2(f'({prev} - {cur})', prev)} AS {cur}_step_drop_pct",
        ]
    cols.append(f"{pct2('purchase', 'app_open')} AS overall_conversion_pct")
    return _q(f"""
, reached AS (
  SELECT DISTINCT CAST(date_trunc('week', s.session_date) AS DATE) AS week, s.device_type, s.user_id, e.event_type
  FROM app_sessions s LEFT JOIN app_events e ON e.session_id = s.session_id
),
per_week AS (
  SELECT week, device_type,
    {_stage_counts('reached', 'user_id')}
  FROM reached GROUP BY week, device_type
)
SELECT {', '.join(cols)} FROM per_week""")


def funnel_sessions(device_type: str | None = None, channel: str | None = None) -> str:
    where = []
    if device_type is not None:
        where.append(f"s.device_type = '{device_type}'")
    if channel is not None:
        where.append(f"u.acquisition_channel = '{channel}'")
    where_sql = ("WHERE " + " AND ".join(where)) if where else ""
    stage_rows = ", ".join(f"({i}, '{name}')" for i, name in enumerate(STAGES))
    return _q(f"""
, reached AS (
  SELECT DISTINCT s.session_id, e.event_type
  FROM app_sessions s
  JOIN app_users u ON u.user_id = s.user_id
  LEFT JOIN app_events e ON e.session_id = s.session_id
  {where_sql}
),
stage_dim AS (SELECT * FROM (VALUES {stage_rows}) AS t(stage_idx, funnel_stage)),
volumes AS (
  SELECT d.stage_idx, d.funnel_stage, COUNT(r.session_id) AS session_volume
  FROM stage_dim d LEFT JOIN reached r ON r.event_type = d.funnel_stage
  GROUP BY d.stage_idx, d.funnel_stage
),
neighbours AS (
  SELECT *, LAG(session_volume) OVER (ORDER BY stage_idx) AS prev_volume,
         FIRST_VALUE(session_volume) OVER (ORDER BY stage_idx) AS first_volume
  FROM volumes
)
SELECT stage_idx, funnel_stage, session_volume,
  CASE WHEN stage_idx = 0 THEN 100.0 WHEN prev_volume > 0 THEN {pct2('session_volume', 'prev_volume')} ELSE 0.0 END
    AS step_conversion_pct,
  CASE WHEN stage_idx = 0 THEN 0.0 WHEN prev_volume > 0 THEN {spct2('(prev_volume - session_volume)', 'prev_volume')}
    ELSE 100.0 END AS step_dropoff_pct,
  {pct2('session_volume', 'GREATEST(first_volume, 1)')} AS overall_completion_pct
FROM neighbours""")


def _active_on(offset: int) -> str:
    return (
        f"CAST(EXISTS (SELECT 1 FROM app_sessions s WHERE s.user_id = u.user_id "
        f"AND s.session_date = u.signup_date + {offset}) AS INTEGER)"
    )


_COHORT = f"""
, cohort AS (
  SELECT u.user_id, u.acquisition_channel,
    {_active_on(0)} AS on_day0, {_active_on(1)} AS on_day1, {_active_on(7)} AS on_day7
  FROM app_users u
)"""


def retention_by_channel() -> str:
    return _q(_COHORT + f"""
SELECT acquisition_channel, COUNT(*) AS cohort_size,
  CAST(SUM(on_day1) AS BIGINT) AS day1_active_users,
  {pct2('SUM(on_day1)', 'COUNT(*)')} AS day1_retention_pct,
  CAST(SUM(on_day7) AS BIGINT) AS day7_active_users,
  {pct2('SUM(on_day7)', 'COUNT(*)')} AS day7_retention_pct
FROM cohort GROUP BY acquisition_channel""")


def retention_grid() -> str:
    return _q(_COHORT + f"""
SELECT acquisition_channel, COUNT(*) AS cohort_size,
  CAST(SUM(on_day0) AS BIGINT) AS d0_users,
  CAST(SUM(on_day1) AS BIGINT) AS d1_users,
  {pct2('SUM(on_day1)', 'COUNT(*)')} AS d1_retention_pct,
  CAST(SUM(on_day7) AS BIGINT) AS d7_users,
  {pct2('SUM(on_day7)', 'COUNT(*)')} AS d7_retention_pct
FROM cohort GROUP BY acquisition_channel""")


def retention_validation() -> str:
    def on(n: int) -> str:
        return f"COUNT(DISTINCT u.user_id) FILTER (WHERE date_diff('day', u.signup_date, s.session_date) = {n})"

    return _q(f"""
, per_channel AS (
  SELECT u.acquisition_channel, COUNT(DISTINCT u.user_id) AS total_users,
    {on(0)} AS d0_users, {on(1)} AS d1_users, {on(7)} AS d7_users
  FROM app_users u LEFT JOIN app_sessions s ON s.user_id = u.user_id
  GROUP BY u.acquisition_channel
)
SELECT *,
  CASE WHEN total_users > 0 THEN d1_users / total_users * 100.0 ELSE 0.0 END AS d1_pct,
  CASE WHEN total_users > 0 THEN d7_users / total_users * 100.0 ELSE 0.0 END AS d7_pct
FROM per_channel""")


def acquisition_share() -> str:
    return _q(f"""
, sizes AS (SELECT acquisition_channel, COUNT(*) AS cohort_size FROM app_users GROUP BY acquisition_channel)
SELECT acquisition_channel, cohort_size,
  {pct2('cohort_size', 'SUM(cohort_size) OVER ()')} AS share_pct
FROM sizes""")


def _units(col: str) -> str:
    return f"CAST(CAST({col} AS DECIMAL(18,4)) * {UNITS} AS BIGINT)"


def _money(units: str, count: str = "1") -> str:
    """Units, or their mean, half-up to cents in whole numbers."""
    n, d = f"CAST({units} AS HUGEINT)", f"NULLIF(CAST({count} AS HUGEINT) * {UNITS}, 0)"
    return f"(SIGN({n}) * CAST((200 * ABS({n}) + {d}) // (2 * {d}) AS DOUBLE) / 100.0)"


def business_kpis(city: str | None = None, channel: str | None = None) -> str:
    conds = []
    if city is not None:
        conds.append(f"city = '{city}'")
    if channel is not None:
        conds.append(f"acquisition_channel = '{channel}'")
    where_sql = ("WHERE " + " AND ".join(conds)) if conds else ""
    return _q(f"""
, kept AS (SELECT user_id FROM app_users {where_sql}),
kept_sessions AS (SELECT session_id FROM app_sessions WHERE user_id IN (SELECT user_id FROM kept)),
order_side AS (
  SELECT SUM({_units('amount')}) AS units, COUNT(amount) AS n_amounts, COUNT(DISTINCT session_id) AS n_order_sessions
  FROM app_orders WHERE user_id IN (SELECT user_id FROM kept)
),
event_side AS (
  SELECT COUNT(DISTINCT session_id) FILTER (WHERE event_type = 'Add To Cart') AS carts,
         COUNT(DISTINCT session_id) FILTER (WHERE event_type = 'Purchase') AS purchases
  FROM app_events WHERE session_id IN (SELECT session_id FROM kept_sessions)
),
card AS (
  SELECT (SELECT units FROM order_side) AS units, (SELECT n_amounts FROM order_side) AS n_amounts,
         (SELECT n_order_sessions FROM order_side) AS total_orders,
         GREATEST((SELECT COUNT(DISTINCT session_id) FROM kept_sessions), 1) AS total_sessions,
         GREATEST((SELECT carts FROM event_side), 1) AS cart_base,
         (SELECT purchases FROM event_side) AS purchases
)
SELECT COALESCE({_money('units')}, 0.0) AS total_revenue,
  COALESCE({_money('units', 'n_amounts')}, 0.0) AS avg_order_value,
  {pct2('total_orders', 'total_sessions')} AS conversion_rate,
  {spct2('(cart_base - purchases)', 'cart_base')} AS abandonment_rate,
  total_orders, CAST(total_sessions AS BIGINT) AS total_sessions
FROM card""")


def topline_kpis() -> str:
    return _q(f"""
, card AS (
  SELECT (SELECT SUM({_units('amount')}) FROM app_orders) AS units,
         (SELECT COUNT(amount) FROM app_orders) AS n_amounts,
         (SELECT COUNT(DISTINCT session_id) FROM app_orders) AS order_sessions,
         (SELECT COUNT(DISTINCT session_id) FROM app_sessions) AS all_sessions,
         (SELECT COUNT(DISTINCT session_id) FILTER (WHERE event_type = 'Add To Cart') FROM app_events) AS carts,
         (SELECT COUNT(DISTINCT session_id) FILTER (WHERE event_type = 'Purchase') FROM app_events) AS purchases
)
SELECT {_money('units')} AS total_revenue_usd,
  {_money('units', 'n_amounts')} AS average_order_value_usd,
  {pct2('order_sessions', 'all_sessions')} AS overall_conversion_rate_pct,
  {spct2('(carts - purchases)', 'carts')} AS cart_abandonment_rate_pct
FROM card""")


def filter_options() -> str:
    return _q("""
, options AS (
  SELECT 'city' AS option_type, city AS value FROM app_users
  UNION
  SELECT 'acquisition_channel', acquisition_channel FROM app_users
)
SELECT option_type, value FROM options ORDER BY option_type, value""")


def table_counts() -> str:
    return _q("\n" + "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM app_{t}"
        for t in ["users", "sessions", "events", "orders", "experiments"]
    ))


def segment_performance() -> str:
    return _q(f"""
, per_user AS (
  SELECT u.user_id, u.user_segment,
    (SELECT COUNT(*) FROM app_sessions s WHERE s.user_id = u.user_id) AS n_sessions,
    (SELECT COALESCE(SUM({_units('o.amount')}), 0)
       FROM app_orders o JOIN app_sessions s ON s.session_id = o.session_id
      WHERE s.user_id = u.user_id) AS spend
  FROM app_users u
),
per_segment AS (
  SELECT user_segment, COUNT(*) AS user_count, CAST(SUM(n_sessions) AS BIGINT) AS total_sessions,
         CAST(SUM(spend) AS BIGINT) AS spend
  FROM per_user GROUP BY user_segment
)
SELECT user_segment, user_count, total_sessions,
  {rr('total_sessions', 'user_count')} AS avg_sessions_per_user,
  {_money('spend')} AS total_spend_usd,
  {_money('spend', 'user_count')} AS arpu
FROM per_segment""")


def segment_by_channel() -> str:
    return _q("""
SELECT acquisition_channel, user_segment, COUNT(*) AS cnt
FROM app_users GROUP BY acquisition_channel, user_segment
ORDER BY acquisition_channel, user_segment""")


_GROUP_STAGES = """
, session_types AS (
  SELECT DISTINCT s.session_id, s.user_id, e.event_type
  FROM app_sessions s JOIN app_events e ON e.session_id = s.session_id
),
user_groups AS (SELECT DISTINCT user_id, experiment_group FROM app_experiments),
ab AS (
  SELECT g.experiment_group,
    COUNT(*) FILTER (WHERE t.event_type = 'Checkout') AS checkout_sessions,
    COUNT(*) FILTER (WHERE t.event_type = 'Purchase') AS purchase_sessions
  FROM session_types t JOIN user_groups g ON g.user_id = t.user_id
  GROUP BY g.experiment_group
)"""


def ab_results() -> str:
    return _q(_GROUP_STAGES + f"""
SELECT experiment_group, checkout_sessions, purchase_sessions,
  {pct2('purchase_sessions', 'checkout_sessions')} AS conversion_rate_pct
FROM ab""")


def ab_raw() -> str:
    return _q(_GROUP_STAGES + """
SELECT experiment_group, checkout_sessions, purchase_sessions,
  purchase_sessions / NULLIF(checkout_sessions, 0) * 100.0 AS conversion_rate_pct
FROM ab""")


def ab_lift() -> str:
    rate = pct2('purchase_sessions', 'checkout_sessions')
    return _q(_GROUP_STAGES + f"""
, rates AS (
  SELECT (SELECT {rate} FROM ab WHERE experiment_group = '{schemas.GROUP_A}') AS rate_a,
         (SELECT {rate} FROM ab WHERE experiment_group = '{schemas.GROUP_B}') AS rate_b
)
SELECT rate_a, rate_b, rate_b - rate_a AS abs_lift_pts,
  (rate_b - rate_a) / NULLIF(rate_a, 0.0) * 100.0 AS rel_lift_pct
FROM rates""")


def ab_significance() -> str:
    a, b = schemas.GROUP_A, schemas.GROUP_B
    return _q(f"""
, checked_out AS (SELECT DISTINCT session_id FROM app_events WHERE event_type = 'Checkout'),
bought AS (SELECT DISTINCT session_id FROM app_events WHERE event_type = 'Purchase'),
trials AS (
  SELECT g.experiment_group, s.session_id, s.session_id IN (SELECT session_id FROM bought) AS success
  FROM app_sessions s
  JOIN checked_out c ON c.session_id = s.session_id
  JOIN (SELECT DISTINCT user_id, experiment_group FROM app_experiments) g ON g.user_id = s.user_id
),
tally AS (
  SELECT COUNT(*) FILTER (WHERE experiment_group = '{a}') AS n_a,
         COUNT(*) FILTER (WHERE experiment_group = '{a}' AND success) AS x_a,
         COUNT(*) FILTER (WHERE experiment_group = '{b}') AS n_b,
         COUNT(*) FILTER (WHERE experiment_group = '{b}' AND success) AS x_b
  FROM trials
),
proportions AS (
  SELECT *,
    CASE WHEN n_a > 0 AND n_b > 0 THEN x_a / n_a END AS rate_a,
    CASE WHEN n_a > 0 AND n_b > 0 THEN x_b / n_b END AS rate_b,
    CASE WHEN n_a > 0 AND n_b > 0 THEN (x_a + x_b) / (n_a + n_b) END AS pooled
  FROM tally
),
tested AS (
  SELECT n_a, x_a, n_b, x_b, rate_a, rate_b,
    CASE WHEN pooled > 0 AND pooled < 1
         THEN (rate_b - rate_a) / SQRT(pooled * (1.0 - pooled) * (1.0 / n_a + 1.0 / n_b)) END AS z_score
  FROM proportions
)
SELECT *, ABS(z_score) > 2.576 AS significant_99 FROM tested""")


def ab_pvalue() -> str:
    """The four counts of ``ab_significance``; erfc by the same published
    approximation, written as a sum of powers."""
    from tidemark.plans.reports import ERFC_A, ERFC_P  # noqa: PLC0415

    series = " + ".join(f"({a}) * pow(t, {i + 1})" for i, a in enumerate(ERFC_A))
    return f"""
WITH counts AS (SELECT n_a::DOUBLE AS n_a, x_a::DOUBLE AS x_a, n_b::DOUBLE AS n_b, x_b::DOUBLE AS x_b FROM ({ab_significance()})),
cells AS (
  SELECT *, n_a + n_b AS n, x_a + x_b AS bought, n_a + n_b - x_a - x_b AS unbought,
         n_a > 0 AND n_b > 0 AND x_a + x_b > 0 AND n_a + n_b - x_a - x_b > 0 AS defined
  FROM counts
),
expected AS (
  SELECT defined, CASE WHEN defined THEN
    pow(x_a - n_a * bought / n, 2) / (n_a * bought / n) + pow(x_b - n_b * bought / n, 2) / (n_b * bought / n)
    + pow(x_a - n_a * bought / n, 2) / (n_a * unbought / n) + pow(x_b - n_b * bought / n, 2) / (n_b * unbought / n)
  END AS chi2 FROM cells
),
tail AS (SELECT *, 1 / (1 + {ERFC_P}::DOUBLE * sqrt(chi2 / 2)) AS t FROM expected),
tested AS (SELECT *, ({series}) * exp(-chi2 / 2) AS p FROM tail)
SELECT round(p, 6) AS p_value, round(chi2, 6) AS chi2_statistic, CAST(defined AS INTEGER) AS dof, p < 0.01 AS significant_99
FROM tested"""


_DEVICE_STAGES = """
, device_types AS (
  SELECT DISTINCT s.device_type, s.session_id, e.event_type
  FROM app_sessions s JOIN app_events e ON e.session_id = s.session_id
),
per_device AS (
  SELECT device_type,
    COUNT(*) FILTER (WHERE event_type = 'Add To Cart') AS cart_sessions,
    COUNT(*) FILTER (WHERE event_type = 'Checkout') AS checkout_sessions
  FROM device_types GROUP BY device_type
),
with_rate AS (
  SELECT *, checkout_sessions / NULLIF(cart_sessions, 0) * 100.0 AS transition_rate_pct FROM per_device
)"""


def device_checkout() -> str:
    return _q(_DEVICE_STAGES + "\nSELECT * FROM with_rate")


def device_leakage(threshold_pts: float = 10.0) -> str:
    return _q(_DEVICE_STAGES + f"""
, others AS (
  SELECT *,
    (SUM(checkout_sessions) OVER () - checkout_sessions)
      / NULLIF(SUM(cart_sessions) OVER () - cart_sessions, 0) * 100.0 AS other_rate_pct
  FROM with_rate
)
SELECT *, other_rate_pct - transition_rate_pct AS gap_pts,
  COALESCE(other_rate_pct - transition_rate_pct > {threshold_pts}, FALSE) AS leakage_flag
FROM others""")


# --- derived entities ---------------------------------------------------------


def sessions_built() -> str:
    return _q("\nSELECT session_id, user_id, session_duration, device_type, session_date, discount_coupon_applied FROM app_sessions")


def user_active_days() -> str:
    return _q("\nSELECT user_id, COUNT(DISTINCT session_date) AS active_days FROM app_sessions GROUP BY user_id")


def user_segments() -> str:
    return _q("\nSELECT user_id, signup_date, city, acquisition_channel, user_segment FROM app_users")


def experiment_assignment() -> str:
    return _q("\nSELECT experiment_id, user_id, experiment_group, feature_name, launch_date FROM app_experiments")


def orders_built() -> str:
    return _q("\nSELECT order_id, user_id, session_id, amount, category, order_date FROM app_orders")


# --- cart model inputs ------------------------------------------------------------

# Earlier orders of the session's user, as an inequality join.
_PRIOR = """
, prior AS (
  SELECT s.session_id, s.user_id, s.session_date, COUNT(o.user_id) AS past_purchases_count
  FROM app_sessions s LEFT JOIN app_orders o ON o.user_id = s.user_id AND o.order_date < s.session_date
  GROUP BY s.session_id, s.user_id, s.session_date
)"""

_CART_FEATURES = _PRIOR + """,
event_tally AS (
  SELECT s.session_id, s.session_duration, s.discount_coupon_applied, s.device_type,
    COUNT(e.event_id) FILTER (WHERE e.event_type = 'View Product') AS num_products_viewed,
    COUNT(e.event_id) FILTER (WHERE e.event_type = 'Add To Cart') AS items_added_to_cart,
    COUNT(e.event_id) FILTER (WHERE e.event_type = 'Purchase') AS purchase_events
  FROM app_sessions s LEFT JOIN app_events e ON e.session_id = s.session_id
  GROUP BY s.session_id, s.session_duration, s.discount_coupon_applied, s.device_type
),
cart_features AS (
  SELECT t.session_id, t.session_duration, t.num_products_viewed, t.items_added_to_cart,
    t.discount_coupon_applied, p.past_purchases_count,
    CASE WHEN t.device_type = 'iOS' THEN 1 ELSE 0 END AS is_ios,
    CASE WHEN t.purchase_events = 0 THEN 1 ELSE 0 END AS abandoned
  FROM event_tally t JOIN prior p ON p.session_id = t.session_id
  WHERE t.items_added_to_cart > 0
)"""


def past_purchases() -> str:
    return _q(_PRIOR + "\nSELECT session_id, user_id, session_date, past_purchases_count FROM prior")


def cart_features() -> str:
    return _q(_CART_FEATURES + "\nSELECT * FROM cart_features")


def feature_sample(n: int = 5) -> str:
    return _q(_CART_FEATURES + f"\nSELECT * FROM cart_features ORDER BY session_id LIMIT {n}")


def label_distribution() -> str:
    return _q(_CART_FEATURES + """
SELECT abandoned, COUNT(*) AS n,
  CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS fraction
FROM cart_features GROUP BY abandoned""")


def stratified_split(test_pct: int = 20, seed: int = 42) -> str:
    return _q(_CART_FEATURES + f"""
, ranked AS (
  SELECT session_id, abandoned,
    ROW_NUMBER() OVER (PARTITION BY abandoned ORDER BY md5('{seed}:' || CAST(session_id AS VARCHAR))) AS rn,
    COUNT(*) OVER (PARTITION BY abandoned) AS n
  FROM cart_features
)
SELECT session_id, abandoned, CASE WHEN rn <= (n * {test_pct} + 50) // 100 THEN 'test' ELSE 'train' END AS split
FROM ranked""")


_SPLIT = _CART_FEATURES + """,
numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY abandoned ORDER BY md5('42:' || CAST(session_id AS VARCHAR))) AS rn,
         COUNT(*) OVER (PARTITION BY abandoned) AS class_rows
  FROM cart_features
),
train AS (SELECT * FROM numbered WHERE rn > (class_rows * 20 + 50) // 100),
test AS (SELECT * FROM numbered WHERE rn <= (class_rows * 20 + 50) // 100)"""


def class_weights() -> str:
    return _q(_SPLIT + """
SELECT abandoned, COUNT(*) AS n,
  round((SELECT COUNT(*) FROM train)::DOUBLE / ((SELECT COUNT(DISTINCT abandoned) FROM train) * COUNT(*)), 6) AS weight
FROM train GROUP BY abandoned""")


def feature_scaling() -> str:
    from tidemark.plans.ml import FEATURES  # noqa: PLC0415

    return _q(_SPLIT + "".join(
        f"{' UNION ALL' if i else ''}\nSELECT '{c}' AS feature, round(avg(COALESCE({c}, 0)::DOUBLE), 6) AS mean, "
        f"round(stddev_samp(COALESCE({c}, 0)::DOUBLE), 6) AS deviation FROM train"
        for i, c in enumerate(FEATURES)
    ))


def rule_report() -> str:
    """Per class as by definition, from the test rows themselves."""
    from tidemark.plans.ml import RULE_VIEWS_PER_ITEM  # noqa: PLC0415

    def count(cond: str) -> str:
        return f"(SELECT COUNT(*) FROM judged WHERE {cond})::DOUBLE"

    n = count("TRUE")
    rates = {"accuracy": f"{count('said = abandoned')} / NULLIF({n}, 0)"}
    for c in (0, 1):
        hit, said, real = (count(x) for x in (f"said = {c} AND abandoned = {c}", f"said = {c}", f"abandoned = {c}"))
        rates |= {
            f"precision_{c}": f"{hit} / NULLIF({said}, 0)",
            f"recall_{c}": f"{hit} / NULLIF({real}, 0)",
            f"f1_{c}": f"2 * {hit} / NULLIF({said} + {real}, 0)",
            f"support_{c}": real,
        }
    for m in ("precision", "recall", "f1"):
        a, b = (f"COALESCE({rates[f'{m}_{c}']}, 0)" for c in (0, 1))
        rates[f"{m}_macro"] = f"({a} + {b}) / 2"
        rates[f"{m}_weighted"] = f"({a} * {rates['support_0']} + {b} * {rates['support_1']}) / NULLIF({n}, 0)"
    rows = "\nUNION ALL ".join(f"SELECT '{k}' AS metric, round({v}, 6) AS value" for k, v in rates.items())
    return _q(_SPLIT + f""",
judged AS (SELECT abandoned, CAST(num_products_viewed < items_added_to_cart * {RULE_VIEWS_PER_ITEM} AS INTEGER) AS said FROM test)
{rows}""")


def risk_bands() -> str:
    return _q("""
, tally AS (
  SELECT s.session_id, s.device_type, COUNT(*) FILTER (WHERE e.event_type = 'Add To Cart') AS items_added_to_cart,
         COUNT(*) FILTER (WHERE e.event_type = 'View Product') AS views
  FROM app_sessions s JOIN app_events e ON e.session_id = s.session_id GROUP BY s.session_id, s.device_type
),
scored AS (
  SELECT session_id, items_added_to_cart, CASE WHEN items_added_to_cart = 0 THEN 100.0 ELSE
    CAST(least(100, 10 * items_added_to_cart + 5 * views + CASE WHEN device_type = 'iOS' THEN 20 ELSE 0 END) AS DOUBLE)
  END::DOUBLE AS risk_pct
  FROM tally
)
SELECT *, CASE WHEN risk_pct > 70 THEN 'HIGH' WHEN risk_pct > 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
  CASE WHEN risk_pct > 70 THEN 'offer' ELSE 'maintain' END AS action
FROM scored""")


# --- integrity audit ----------------------------------------------------------------


def _defects() -> str:
    """The spoiled tables of ``audit.with_defects`` as bad_<table>."""
    from tidemark.operators import audit  # noqa: PLC0415

    return f"""
, bad_users AS (
  SELECT * REPLACE (CASE WHEN user_id % {audit.BLANK_CITIES} <> 0 THEN city END AS city)
  FROM app_users WHERE user_id % {audit.LOST_USERS} <> 0
),
bad_sessions AS (SELECT * REPLACE (CASE WHEN user_id % {audit.BLANK_DEVICES} <> 0 THEN device_type END AS device_type) FROM app_sessions),
bad_events AS (SELECT * FROM app_events),
bad_orders AS (SELECT * FROM app_orders UNION ALL SELECT * FROM app_orders WHERE order_id % {audit.DOUBLE_ORDERS} = 0),
bad_experiments AS (SELECT * FROM app_experiments)"""


def integrity_audit(defects: bool = False) -> str:
    parts = []
    for table, key in schemas.PRIMARY_KEYS.items():
        parts.append(
            f"SELECT 'duplicate_key' AS check_name, '{table}' AS table_name, '{key}' AS column_name, "
            f"(SELECT COUNT(*) FROM (SELECT {key} FROM app_{table} GROUP BY {key} HAVING COUNT(*) > 1)) AS violations"
        )
    for table, schema in schemas.TABLE_SCHEMAS.items():
        for f in schema.fields:
            if not f.nullable:
                parts.append(
                    f"SELECT 'null_value', '{table}', '{f.name}', "
                    f"(SELECT COUNT(*) FROM app_{table} WHERE \"{f.name}\" IS NULL)"
                )
    for child, col, parent, pcol in schemas.FOREIGN_KEYS:
        parts.append(
            f"SELECT 'orphan_key', '{child}', '{col}', (SELECT COUNT(*) FROM app_{child} c WHERE c.{col} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM app_{parent} p WHERE p.{pcol} = c.{col}))"
        )
    if defects:
        return _q(_defects() + ("\n" + "\nUNION ALL ".join(parts)).replace("app_", "bad_"))
    return _q("\n" + "\nUNION ALL ".join(parts))


# --- briefing context ---------------------------------------------------------------


def _unpivot(cte: str, section: str, entity: str, metrics: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{section}' AS section, CAST({entity} AS VARCHAR) AS entity, '{m}' AS metric, "
        f"CAST({m} AS DOUBLE) AS value FROM {cte}"
        for m in metrics
    )


def briefing_context() -> str:
    from tidemark.plans.reports import BRIEFING_METRICS as M  # noqa: PLC0415

    ctes = {
        "fa": funnel_sessions(),
        "fi": funnel_sessions(device_type="iOS"),
        "fd": funnel_sessions(device_type="Android"),
        "rt": retention_by_channel(),
        "ab": ab_results(),
        "sg": segment_performance(),
        "lf": ab_lift(),
    }
    with_sql = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    gap_d1 = pct2("(SUM(day1_active_users) OVER () - day1_active_users)", "(SUM(cohort_size) OVER () - cohort_size)")
    gap_d7 = pct2("(SUM(day7_active_users) OVER () - day7_active_users)", "(SUM(cohort_size) OVER () - cohort_size)")
    body = [
        _unpivot("fa", "funnel_all", "funnel_stage", M["funnel"]),
        _unpivot("fi", "funnel_ios", "funnel_stage", M["funnel"]),
        _unpivot("fd", "funnel_android", "funnel_stage", M["funnel"]),
        _unpivot("rt", "retention", "acquisition_channel", M["retention"]),
        _unpivot("ab", "ab_test", "experiment_group", M["ab_test"]),
        _unpivot("sg", "segments", "user_segment", M["segments"]),
        _unpivot(
            "(SELECT 'Checkout' AS stage, "
            "(SELECT step_conversion_pct FROM fi WHERE funnel_stage = 'Checkout') - "
            "(SELECT step_conversion_pct FROM fd WHERE funnel_stage = 'Checkout') AS step_conversion_gap_pts, "
            "(SELECT step_dropoff_pct FROM fi WHERE funnel_stage = 'Checkout') - "
            "(SELECT step_dropoff_pct FROM fd WHERE funnel_stage = 'Checkout') AS step_dropoff_gap_pts)",
            "ios_vs_android", "stage", ["step_conversion_gap_pts", "step_dropoff_gap_pts"],
        ),
        _unpivot(
            f"(SELECT acquisition_channel, day1_retention_pct - {gap_d1} AS day1_retention_gap_pts, "
            f"day7_retention_pct - {gap_d7} AS day7_retention_gap_pts FROM rt)",
            "channel_vs_others", "acquisition_channel", ["day1_retention_gap_pts", "day7_retention_gap_pts"],
        ),
        _unpivot("(SELECT 'B vs A' AS comparison, * FROM lf)", "b_vs_a", "comparison", ["abs_lift_pts", "rel_lift_pct"]),
    ]
    return f"WITH {with_sql}\n" + "\nUNION ALL ".join(body)


# --- text output ----------------------------------------------------------------------


def _number_text(value: str, decimals: int, grouped: bool = True) -> str:
    return f"format('{{:{',' if grouped else ''}.{decimals}f}}', CAST({value} AS DOUBLE))"


def _money_text(value: str, grouped: bool = True) -> str:
    return f"'$' || {_number_text(value, 2, grouped)}"


def _percent_text(value: str) -> str:
    return f"{_number_text(value, 2, False)} || '%'"


def kpi_text() -> str:
    return f"""SELECT {_money_text('total_revenue')} AS total_revenue, {_money_text('avg_order_value', False)} AS avg_order_value,
  {_percent_text('conversion_rate')} AS conversion_rate, {_percent_text('abandonment_rate')} AS abandonment_rate,
  {_number_text('total_orders', 0)} AS total_orders, {_number_text('total_sessions', 0)} AS total_sessions
FROM ({business_kpis()})"""


def briefing_text() -> str:
    return f"""SELECT section, entity, metric,
  CASE WHEN metric IN ('total_spend_usd', 'arpu') THEN {_money_text('value')}
       WHEN suffix(metric, '_pct') OR suffix(metric, '_pts') THEN {_percent_text('value')}
       WHEN metric = 'avg_sessions_per_user' THEN {_number_text('value', 2)}
       ELSE {_number_text('value', 0)} END AS value_text
FROM ({briefing_context()})"""


def orders_text() -> str:
    return _q("""
SELECT order_id, user_id, session_id, amount, category, strftime(order_date, '%Y-%m-%d') AS order_date FROM app_orders""")


def events_text() -> str:
    return _q("""
SELECT event_id, user_id, session_id, event_type, feature_name, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp"
FROM app_events""")
