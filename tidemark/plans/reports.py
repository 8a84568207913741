"""The reports as DataFrame plans over the five app tables.

Conventions kept from the reference, per report:

* SQL-style reports return NULL on a zero denominator (``NULLIF``);
  query-layer reports clamp the denominator to at least 1 or return 0.
* Rounded rates of counts use exact half-up rounding (``pct2``); unrounded
  rates are ``100 * a / b`` in double precision.
* Output columns are snake_case; ``DISPLAY_NAMES`` maps them to the
  dashboard's labels (``with_display_names``).

No report collects to the driver: one-row results are built with global
aggregates, and the few "relative to another row" metrics use a window over
an already aggregated, size-bounded result (six stages, three devices, the
channels) or conditional aggregation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import money, money_text, number_text, optional_eq, pct2, percent_text, round_ratio, signed_pct2
from tidemark.operators import bitmaps, flags
from tidemark.plans.mart import STAGE_SESSIONS, order_aggs, order_facts, s_col, session_mart, user_device_facts
from tidemark.sources import schemas
from tidemark.sources.io import AppTables

STAGE_KEYS = schemas.STAGE_KEYS


def _sum_long(col: str) -> F.Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def _one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates with disjoint columns into one row without
    a join: union them (missing columns are NULL) and keep each column's only
    non-NULL value."""
    combined = frames[0]
    for f in frames[1:]:
        combined = combined.unionByName(f, allowMissingColumns=True)
    return combined.agg(*[F.max(c).alias(c) for c in combined.columns])


# --- J7 user funnel by device -------------------------------------------------


def funnel_by_device(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """Users per device reaching each stage, with step conversion and drop-off
    (NULL on a zero denominator) and overall conversion. A user on two devices
    counts in both; devices whose sessions have no events stay, with zeros."""
    facts = user_device_facts(tables, mart)
    return _user_funnel(facts.groupBy("device_type").agg(*[F.count_if(F.col(s_col(k)) > 0).alias(k) for k in STAGE_KEYS]))


def _user_funnel(per_device: DataFrame, *more: str) -> DataFrame:
    """Conversions of users by device (and ``more``) and stage."""
    cols = [*more, F.col("device_type"), F.col("app_open").alias("app_open_users")]
    for prev, cur in zip(STAGE_KEYS, STAGE_KEYS[1:]):
        cols += [
            F.col(cur).alias(f"{cur}_users"),
            pct2(cur, prev).alias(f"{cur}_step_conv_pct"),
            signed_pct2(F.col(prev) - F.col(cur), F.col(prev)).alias(f"{cur}_step_drop_pct"),
        ]
    cols.append(pct2("purchase", "app_open").alias("overall_conversion_pct"))
    return per_device.select(*cols)


def funnel_by_device_weekly(tables: AppTables, daily: DataFrame | None = None) -> DataFrame:
    """``funnel_by_device`` for every week (by its Monday), from the daily
    bitmaps of users: those of ``daily``, or built from the mart."""
    daily = daily if daily is not None else bitmaps.daily_stage_bitmaps(session_mart(tables))
    week = F.trunc("day", "week").alias("week")
    return _user_funnel(bitmaps.distinct_users(bitmaps.merged(daily, week, "device_type"), "week", "device_type"), "week")


def funnel_by_device_between(daily: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """``funnel_by_device`` over a range of days, from stored daily bitmaps."""
    some = bitmaps.merged(bitmaps.between(daily, first, last), "device_type")
    return _user_funnel(bitmaps.distinct_users(some, "device_type"))


# --- J2 session funnel --------------------------------------------------------


def funnel_sessions(
    tables: AppTables,
    device_type: str | None = None,
    channel: str | None = None,
    mart: DataFrame | None = None,
) -> DataFrame:
    """Six rows (stage order): sessions reaching each stage, step conversion
    (first row 100.0; 0.0 after an empty stage), step drop-off (first row 0.0;
    100.0 after an empty stage) and completion relative to the first stage
    with its base clamped to at least 1. Sessions of unknown users are
    excluded (inner join with users). Stages are not ordered in time: a stage
    counts sessions having any event of that type."""
    # Sessions per user and device first (map-side combined), so the join with
    # users sees few rows per user however many sessions a hot user has.
    per_user = optional_eq(user_device_facts(tables, mart).select("user_id", "device_type", *_stages()), "device_type", device_type)
    users = optional_eq(tables.users.select("user_id", "acquisition_channel"), "acquisition_channel", channel)
    return per_user.join(users.select("user_id"), "user_id").agg(*_stage_sums()).select(_funnel_rows())


def _stages() -> list[F.Column]:
    return [F.col(s).alias(k) for s, k in zip(STAGE_SESSIONS, STAGE_KEYS)]


def funnels_by_scope(tables: AppTables, devices: dict[str, str], mart: DataFrame | None = None) -> DataFrame:
    """``funnel_sessions`` of all sessions (scope ``all``) and of some devices
    (scope by device), from one aggregation."""
    per_user = user_device_facts(tables, mart).select("user_id", "device_type", *_stages())
    known = per_user.join(tables.users.select("user_id"), "user_id")
    by_device = known.groupBy("device_type").agg(*_stage_sums())
    # Every scope has a row of zeros beside its devices, as an empty funnel has rows too.
    names = F.array(F.lit("all"), *[F.lit(scope) for scope in devices.values()])
    of_device = F.array_compact(
        F.array(F.lit("all"), *[F.when(F.col("device_type") == d, F.lit(scope)) for d, scope in devices.items()])
    )
    zeros = tables.users.sparkSession.range(1).select(F.explode(names).alias("scope"), *[F.lit(0).cast("bigint").alias(k) for k in STAGE_KEYS])
    scoped = by_device.select(F.explode(of_device).alias("scope"), *STAGE_KEYS).unionByName(zeros)
    return scoped.groupBy("scope").agg(*_stage_sums()).select("scope", _funnel_rows())


def _stage_sums() -> list[F.Column]:
    return [_sum_long(k).alias(k) for k in STAGE_KEYS]


def _funnel_rows() -> F.Column:
    base = F.greatest(F.col(STAGE_KEYS[0]), F.lit(1))
    rows = []
    for i, key in enumerate(STAGE_KEYS):
        if i == 0:
            conv, drop = F.lit(100.0), F.lit(0.0)
        else:
            prev = F.col(STAGE_KEYS[i - 1])
            conv = F.when(prev > 0, pct2(key, prev)).otherwise(F.lit(0.0))
            drop = F.when(prev > 0, signed_pct2(prev - F.col(key), prev)).otherwise(F.lit(100.0))
        rows.append(
            F.struct(
                F.lit(i).alias("stage_idx"),
                F.lit(schemas.STAGES[i]).alias("funnel_stage"),
                F.col(key).alias("session_volume"),
                conv.alias("step_conversion_pct"),
                drop.alias("step_dropoff_pct"),
                pct2(F.col(key), base).alias("overall_completion_pct"),
            )
        )
    return F.inline(F.array(*rows))


# --- J3 / J8 / J11 retention --------------------------------------------------


def _active_on(tables: AppTables, days: tuple[int, ...]) -> DataFrame:
    """Users active on a day of their own counting: distinct (channel, user,
    offset) for the offsets asked for. Sessions are reduced to users' days
    first, and other offsets go before anything is counted."""
    own_days = tables.sessions.select("user_id", "session_date").distinct()
    since = tables.users.select("user_id", "acquisition_channel", "signup_date").join(own_days, "user_id")
    offset = F.date_diff("session_date", "signup_date")
    return since.select("acquisition_channel", "user_id", offset.alias("offset")).filter(F.col("offset").isin(*days)).distinct()


def _retention(tables: AppTables, days: tuple[int, ...]) -> DataFrame:
    """Per channel: cohort_size (its users) and d{n}, the users active n days
    after their signup. Both are counts per channel, stacked and folded, so a
    channel without a session keeps its cohort."""
    cohorts = tables.users.groupBy("acquisition_channel").agg(F.count("user_id").alias("cohort_size"))
    active = _active_on(tables, days).groupBy("acquisition_channel").agg(
        *[F.count_if(F.col("offset") == n).alias(f"d{n}") for n in days]
    )
    return cohorts.unionByName(active, allowMissingColumns=True).groupBy("acquisition_channel").agg(
        *[_sum_long(c).alias(c) for c in ("cohort_size", *[f"d{n}" for n in days])]
    )


def retention_by_channel(tables: AppTables) -> DataFrame:
    """Query-layer retention: cohort size, day-1 and day-7 active users and
    their rates per channel (exact-day retention; NULL rate on empty cohort)."""
    return _retention(tables, (1, 7)).select(
        "acquisition_channel",
        "cohort_size",
        F.col("d1").alias("day1_active_users"),
        pct2("d1", "cohort_size").alias("day1_retention_pct"),
        F.col("d7").alias("day7_active_users"),
        pct2("d7", "cohort_size").alias("day7_retention_pct"),
    )


def retention_grid(tables: AppTables) -> DataFrame:
    """SQL-pack retention grid: as ``retention_by_channel`` plus day-0 users."""
    return _retention(tables, (0, 1, 7)).select(
        "acquisition_channel",
        "cohort_size",
        F.col("d0").alias("d0_users"),
        F.col("d1").alias("d1_users"),
        pct2("d1", "cohort_size").alias("d1_retention_pct"),
        F.col("d7").alias("d7_users"),
        pct2("d7", "cohort_size").alias("d7_retention_pct"),
    )


def retention_validation(tables: AppTables) -> DataFrame:
    """Load check of ``retention_grid``, by another way: for each offset the
    sessions' day is moved back to the signup it would retain, and the users
    that match are looked up by (user, signup). Unrounded rates, 0 for an
    empty channel."""
    users = tables.users.select("user_id", "acquisition_channel", "signup_date")
    offsets = F.explode(F.array(F.lit(0), F.lit(1), F.lit(7)))
    wanted = tables.sessions.select("user_id", "session_date", offsets.alias("offset")).select(
        "user_id", "offset", F.date_sub("session_date", F.col("offset")).alias("signup_date")
    )
    found = users.join(wanted, ["user_id", "signup_date"])
    tagged = found.select("acquisition_channel", "user_id", "offset").unionByName(
        users.select("acquisition_channel", "user_id", F.lit(-1).alias("offset"))
    )
    counts = tagged.distinct().groupBy("acquisition_channel").agg(
        F.count_if(F.col("offset") == -1).alias("total_users"),
        *[F.count_if(F.col("offset") == n).alias(f"d{n}_users") for n in (0, 1, 7)],
    )
    total = F.col("total_users")
    return counts.select(
        "*", *[F.when(total > 0, F.col(f"d{n}_users") / total * 100.0).otherwise(F.lit(0.0)).alias(f"d{n}_pct") for n in (1, 7)]
    )


def acquisition_share(tables: AppTables) -> DataFrame:
    """Cohort size per channel and its share of all users (percent, 2 dp).
    The window spans only the per-channel rows."""
    sizes = tables.users.groupBy("acquisition_channel").agg(F.count(F.lit(1)).alias("cohort_size"))
    total = F.sum("cohort_size").over(Window.partitionBy())
    return sizes.select("acquisition_channel", "cohort_size", pct2(F.col("cohort_size"), total).alias("share_pct"))


# --- J1 / J9 KPIs -------------------------------------------------------------


def _session_totals(tables: AppTables, mart: DataFrame | None) -> DataFrame:
    """Rows to sum, each with a user: sessions (and those with a cart, with a
    purchase) and order totals. Tables with a rollup have both in their facts;
    otherwise orders are totalled on their own, as they may name another session
    or user than the sessions table."""
    facts = user_device_facts(tables, mart)
    sessions = [F.col("n_sessions"), F.col(s_col("add_to_cart")).alias("n_cart"), F.col(s_col("purchase")).alias("n_purchase")]
    orders = ["n_order_sessions", "n_amounts", "order_units"]
    if tables.session_rollup is not None:
        return facts.select("user_id", *sessions, *orders)
    apart = tables.orders.groupBy("user_id", "session_id").agg(*order_aggs(F.col("amount"), F.lit(True)))
    apart = apart.select("user_id", (F.col("n_orders") > 0).cast("int").alias("n_order_sessions"), "n_amounts", "order_units")
    return facts.select("user_id", *sessions).unionByName(apart, allowMissingColumns=True)


_TOTALS = ["n_sessions", "n_cart", "n_purchase", "n_order_sessions", "n_amounts", "order_units"]


def business_kpis(
    tables: AppTables,
    city: str | None = None,
    channel: str | None = None,
    mart: DataFrame | None = None,
) -> DataFrame:
    """Query-layer KPIs with optional city / channel filters on the user.

    Revenue and AOV are over order rows of known users (0 when none); orders
    count distinct sessions with an order; ``total_sessions`` is clamped to at
    least 1; abandonment is ``(1 - purchase / max(1, cart)) * 100``, so no
    carts and no purchases give 100.0. Sessions and orders are summed per user
    before the users are joined, so a hot user joins as one row."""
    users = optional_eq(optional_eq(tables.users, "city", city), "acquisition_channel", channel).select("user_id")
    per_user = _session_totals(tables, mart).groupBy("user_id").agg(*[F.sum(c).alias(c) for c in _TOTALS])
    row = per_user.join(users, "user_id").agg(*[F.sum(c).alias(c) for c in _TOTALS])
    sessions = F.greatest(F.col("n_sessions"), F.lit(1)).cast("bigint")
    carts = F.greatest(F.col("n_cart"), F.lit(1)).cast("bigint")
    purchases, orders = (F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("n_purchase", "n_order_sessions"))
    return row.select(
        F.coalesce(money("order_units"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(money("order_units", "n_amounts"), F.lit(0.0)).alias("avg_order_value"),
        pct2(orders, sessions).alias("conversion_rate"),
        signed_pct2(carts - purchases, carts).alias("abandonment_rate"),
        orders.alias("total_orders"),
        sessions.alias("total_sessions"),
    )


def topline_kpis(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """SQL-pack KPIs over the base tables (no user join, so orphan orders and
    events count); NULL on empty input. With a rollup every order and event
    is in a session, and one pass over the sessions gives all; otherwise
    events and orders are counted by the sessions that they name."""
    if tables.session_rollup is not None:
        rows = _session_totals(tables, mart)
    else:
        named = flags.stage_counts(tables.events.filter(F.col("session_id").isNotNull()), "session_id").select(
            flags.has_flag("add_to_cart").alias("n_cart"), flags.has_flag("purchase").alias("n_purchase")
        )
        orders = order_facts(tables.orders).select(
            F.col("session_id").isNotNull().cast("int").alias("n_order_sessions"), "n_amounts", "order_units"
        )
        listed = tables.sessions.select("session_id").filter("session_id IS NOT NULL").distinct()
        rows = (
            listed.select(F.lit(1).alias("n_sessions"))
            .unionByName(named, allowMissingColumns=True)
            .unionByName(orders, allowMissingColumns=True)
        )
    row = rows.agg(*[F.sum(c).alias(c) for c in _TOTALS])
    return row.select(
        money("order_units").alias("total_revenue_usd"),
        money("order_units", "n_amounts").alias("average_order_value_usd"),
        pct2(F.coalesce("n_order_sessions", F.lit(0)), "n_sessions").alias("overall_conversion_rate_pct"),
        signed_pct2(F.col("n_cart") - F.col("n_purchase"), F.col("n_cart")).alias("cart_abandonment_rate_pct"),
    )


def filter_options(tables: AppTables) -> DataFrame:
    """Distinct cities and channels, long form (option_type, value), sorted."""
    cities = tables.users.select(F.lit("city").alias("option_type"), F.col("city").alias("value")).distinct()
    channels = tables.users.select(
        F.lit("acquisition_channel").alias("option_type"), F.col("acquisition_channel").alias("value")
    ).distinct()
    return cities.unionByName(channels).orderBy("option_type", "value")


def table_counts(tables: AppTables) -> DataFrame:
    """Row count per table; of tables that were counted while they were written,
    that count."""
    observed = tables.memo.get("observed", {})
    spark = tables.users.sparkSession
    frames = [
        spark.range(1).select(F.lit(name).alias("table_name"), F.lit(observed[name]["rows"]).cast("bigint").alias("row_count"))
        if name in observed
        else tables.as_dict()[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in schemas.TABLE_SCHEMAS
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- J4 / J12 segments --------------------------------------------------------


def segment_performance(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """Per segment: users, sessions, sessions per user, spend and ARPU.
    Orders reach the spend only through a session of the user (the mart's
    per-session order totals); users without sessions count with 0 sessions.
    Spend is summed exactly and rounded once."""
    per_user = user_device_facts(tables, mart).groupBy("user_id").agg(
        F.sum("n_sessions").alias("n_sessions"), F.sum("order_units").alias("spend")
    )
    per_segment_user = (
        tables.users.select("user_id", "user_segment")
        .join(per_user, "user_id", "left")
        .groupBy("user_segment", "user_id")
        .agg(F.sum("n_sessions").alias("n_sessions"), F.sum("spend").alias("spend"))
    )
    seg = per_segment_user.groupBy("user_segment").agg(
        F.count("user_id").alias("user_count"),
        _sum_long("n_sessions").alias("total_sessions"),
        F.coalesce(F.sum("spend"), F.lit(0)).alias("spend"),
    )
    return seg.select(
        "user_segment",
        "user_count",
        "total_sessions",
        round_ratio("total_sessions", "user_count").alias("avg_sessions_per_user"),
        money("spend").alias("total_spend_usd"),
        money("spend", "user_count").alias("arpu"),
    )


def segment_by_channel(tables: AppTables) -> DataFrame:
    """Users per (channel, segment), ordered by channel then segment."""
    return (
        tables.users.groupBy("acquisition_channel", "user_segment")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy("acquisition_channel", "user_segment")
    )


# --- J5 / J13 / J14 / J15 experiment -----------------------------------------


def _ab_counts(tables: AppTables, mart: DataFrame | None) -> DataFrame:
    """Per group: checkout sessions, purchase sessions and sessions with both.
    Counted per user first (map-side combined), so the join with the
    experiment groups sees one row per user, not per session."""
    per_user = (
        user_device_facts(tables, mart)
        .filter(F.col("n_eventful") > 0)
        .groupBy("user_id")
        .agg(
            F.sum(s_col("checkout")).alias("c"),
            F.sum(s_col("purchase")).alias("p"),
            F.sum("s_checkout_purchase").alias("cp"),
        )
    )
    groups = tables.experiments.select("user_id", "experiment_group").distinct()
    return (
        per_user.join(groups, "user_id")
        .groupBy("experiment_group")
        .agg(
            _sum_long("c").alias("checkout_sessions"),
            _sum_long("p").alias("purchase_sessions"),
            _sum_long("cp").alias("checkout_purchase_sessions"),
        )
    )


def ab_results(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """Checkout→purchase conversion per group at session grain (2 dp)."""
    c = _ab_counts(tables, mart)
    return c.select(
        "experiment_group",
        "checkout_sessions",
        "purchase_sessions",
        pct2("purchase_sessions", "checkout_sessions").alias("conversion_rate_pct"),
    )


def ab_raw(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """``ab_results`` before rounding."""
    c = _ab_counts(tables, mart)
    return c.select(
        "experiment_group",
        "checkout_sessions",
        "purchase_sessions",
        (F.col("purchase_sessions") / F.nullif(F.col("checkout_sessions"), F.lit(0)) * 100.0).alias(
            "conversion_rate_pct"
        ),
    )


def ab_lift(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """Absolute and relative lift of B over A from the rounded rates; NULL
    relative lift when A's rate is 0 or missing."""
    r = ab_results(tables, mart)
    row = r.agg(
        F.max(F.when(F.col("experiment_group") == schemas.GROUP_A, F.col("conversion_rate_pct"))).alias("rate_a"),
        F.max(F.when(F.col("experiment_group") == schemas.GROUP_B, F.col("conversion_rate_pct"))).alias("rate_b"),
    )
    abs_lift = F.col("rate_b") - F.col("rate_a")
    return row.select(
        "rate_a",
        "rate_b",
        abs_lift.alias("abs_lift_pts"),
        (abs_lift / F.nullif(F.col("rate_a"), F.lit(0.0)) * 100.0).alias("rel_lift_pct"),
    )


Z_99 = 2.576  # two-sided 99 % critical value of the standard normal


def ab_significance(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """Pooled two-proportion z-test of B vs A. Trials are sessions with a
    Checkout, successes those that also have a Purchase. ``z_score`` is NULL
    when a group is empty or the pooled rate is 0 or 1."""
    c = _ab_counts(tables, mart)

    def pick(group: str, col: str) -> F.Column:
        return F.coalesce(F.sum(F.when(F.col("experiment_group") == group, F.col(col))), F.lit(0)).cast("bigint")

    row = c.agg(
        pick(schemas.GROUP_A, "checkout_sessions").alias("n_a"),
        pick(schemas.GROUP_A, "checkout_purchase_sessions").alias("x_a"),
        pick(schemas.GROUP_B, "checkout_sessions").alias("n_b"),
        pick(schemas.GROUP_B, "checkout_purchase_sessions").alias("x_b"),
    )
    n_a, x_a, n_b, x_b = (F.col(c_) for c_ in ("n_a", "x_a", "n_b", "x_b"))
    ok = (n_a > 0) & (n_b > 0)
    p_a = F.when(ok, x_a / n_a)
    p_b = F.when(ok, x_b / n_b)
    pooled = F.when(ok, (x_a + x_b) / (n_a + n_b))
    valid = ok & (pooled > 0) & (pooled < 1)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
    z = F.when(valid, (p_b - p_a) / se)
    return row.select(
        "n_a",
        "x_a",
        "n_b",
        "x_b",
        p_a.alias("rate_a"),
        p_b.alias("rate_b"),
        z.alias("z_score"),
        (F.abs(z) > F.lit(Z_99)).alias("significant_99"),
    )


#: The published rational approximation of erfc by Abramowitz and
#: Stegun (7.1.26), absolute error at most 1.5e-7.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _erfc(x: F.Column) -> F.Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_P) * x)
    series = F.lit(0.0)
    for a in reversed(ERFC_A):
        series = (series + F.lit(a)) * t
    return series * F.exp(-x * x)


def ab_pvalue(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """Pearson chi-square test of independence between group (A / B) and
    purchase, over sessions with a Checkout. The statistic follows exactly from
    the four counts, with one degree of freedom; the tail probability is
    erfc(sqrt(chi2 / 2)) by a closed approximation, to six decimals. NULL (and
    0 degrees) when a group or an outcome is missing."""
    row = ab_significance(tables, mart).select("n_a", "x_a", "n_b", "x_b")
    n_a, x_a, n_b, x_b = (F.col(c).cast("double") for c in ("n_a", "x_a", "n_b", "x_b"))
    bought, left = x_a + x_b, n_a + n_b - x_a - x_b
    defined = (n_a > 0) & (n_b > 0) & (bought > 0) & (left > 0)
    cross = x_b * n_a - x_a * n_b
    chi2 = F.when(defined, (n_a + n_b) * cross * cross / (n_a * n_b * bought * left))
    tested = row.select(chi2.alias("chi2"), defined.cast("int").alias("dof"))
    p = _erfc(F.sqrt(F.col("chi2") / 2))
    return tested.select(
        F.round(p, 6).alias("p_value"),
        F.round("chi2", 6).alias("chi2_statistic"),
        "dof",
        (p < F.lit(0.01)).alias("significant_99"),
    )


# --- J10 / J16 device checkout ----------------------------------------------


def device_checkout(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """Cart→checkout per device over sessions with events (unrounded rate)."""
    out = (
        user_device_facts(tables, mart)
        .filter(F.col("n_eventful") > 0)
        .groupBy("device_type")
        .agg(
            _sum_long(s_col("add_to_cart")).alias("cart_sessions"),
            _sum_long(s_col("checkout")).alias("checkout_sessions"),
        )
    )
    return out.select(
        "*",
        (F.col("checkout_sessions") / F.nullif(F.col("cart_sessions"), F.lit(0)) * 100.0).alias(
            "transition_rate_pct"
        ),
    )


def device_leakage(tables: AppTables, threshold_pts: float = 10.0, mart: DataFrame | None = None) -> DataFrame:
    """Per device: its cart→checkout rate, the pooled rate of all other
    devices, the gap in points and ``leakage_flag = gap > threshold_pts``.
    The window spans only the per-device rows."""
    d = device_checkout(tables, mart)
    everything = Window.partitionBy()
    other_cart = F.sum("cart_sessions").over(everything) - F.col("cart_sessions")
    other_checkout = F.sum("checkout_sessions").over(everything) - F.col("checkout_sessions")
    other_rate = other_checkout / F.nullif(other_cart, F.lit(0)) * 100.0
    out = d.select("*", other_rate.alias("other_rate_pct"))
    gap = F.col("other_rate_pct") - F.col("transition_rate_pct")
    return out.select("*", gap.alias("gap_pts"), F.coalesce(gap > F.lit(threshold_pts), F.lit(False)).alias("leakage_flag"))


# --- J19 briefing context ---------------------------------------------------------

BRIEFING_METRICS = {
    "funnel": ["session_volume", "step_conversion_pct", "step_dropoff_pct", "overall_completion_pct"],
    "retention": ["cohort_size", "day1_active_users", "day1_retention_pct", "day7_active_users", "day7_retention_pct"],
    "ab_test": ["checkout_sessions", "purchase_sessions", "conversion_rate_pct"],
    "segments": ["user_count", "total_sessions", "avg_sessions_per_user", "total_spend_usd", "arpu"],
}


def _long(df: DataFrame, section: str, entity: str, metrics: list[str]) -> DataFrame:
    """Unpivot a report to (section, entity, metric, value)."""
    wide = df.select(
        F.lit(section).alias("section"),
        F.col(entity).cast("string").alias("entity"),
        *[F.col(m).cast("double").alias(m) for m in metrics],
    )
    return wide.unpivot(["section", "entity"], metrics, "metric", "value")


def briefing_context(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """The briefing's input tables as one long table (section, entity, metric,
    value): session funnels (all, iOS, Android), retention by channel, A/B
    results and segment performance, plus the comparisons the briefing asks
    for — iOS vs Android at the checkout step, each channel's retention vs
    all other channels pooled, and group B vs A."""
    funnels = funnels_by_scope(tables, {"iOS": "iOS", "Android": "Android"}, mart)
    retention = retention_by_channel(tables)
    ab = ab_results(tables, mart)
    parts = [
        _long(funnels.filter(F.col("scope") == scope), f"funnel_{scope.lower()}", "funnel_stage", BRIEFING_METRICS["funnel"])
        for scope in ("all", "iOS", "Android")
    ]
    parts += [
        _long(retention, "retention", "acquisition_channel", BRIEFING_METRICS["retention"]),
        _long(ab, "ab_test", "experiment_group", BRIEFING_METRICS["ab_test"]),
        _long(segment_performance(tables, mart), "segments", "user_segment", BRIEFING_METRICS["segments"]),
    ]

    # iOS vs Android at the Add To Cart → Checkout step (six-row inputs).
    checkout = "Checkout"
    tagged = funnels.filter(F.col("funnel_stage") == checkout).withColumnRenamed("scope", "device")

    def on(device: str, col: str) -> F.Column:
        return F.max(F.when(F.col("device") == device, F.col(col)))

    device_gap = tagged.agg(
        (on("iOS", "step_conversion_pct") - on("Android", "step_conversion_pct")).alias("step_conversion_gap_pts"),
        (on("iOS", "step_dropoff_pct") - on("Android", "step_dropoff_pct")).alias("step_dropoff_gap_pts"),
    ).select(F.lit(checkout).alias("stage"), "*")
    parts.append(_long(device_gap, "ios_vs_android", "stage", ["step_conversion_gap_pts", "step_dropoff_gap_pts"]))

    # Each channel vs all other channels pooled (window over the channel rows).
    everything = Window.partitionBy()
    others = retention.select(
        "acquisition_channel",
        (
            F.col("day1_retention_pct")
            - pct2(
                F.sum("day1_active_users").over(everything) - F.col("day1_active_users"),
                F.sum("cohort_size").over(everything) - F.col("cohort_size"),
            )
        ).alias("day1_retention_gap_pts"),
        (
            F.col("day7_retention_pct")
            - pct2(
                F.sum("day7_active_users").over(everything) - F.col("day7_active_users"),
                F.sum("cohort_size").over(everything) - F.col("cohort_size"),
            )
        ).alias("day7_retention_gap_pts"),
    )
    parts.append(
        _long(others, "channel_vs_others", "acquisition_channel", ["day1_retention_gap_pts", "day7_retention_gap_pts"])
    )

    lift = ab_lift(tables, mart).select(F.lit("B vs A").alias("comparison"), "abs_lift_pts", "rel_lift_pct")
    parts.append(_long(lift, "b_vs_a", "comparison", ["abs_lift_pts", "rel_lift_pct"]))

    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def kpi_text(tables: AppTables, city: str | None = None, channel: str | None = None) -> DataFrame:
    """``business_kpis`` as the dashboard's cards print them."""
    k = business_kpis(tables, city, channel)
    return k.select(
        money_text("total_revenue").alias("total_revenue"),
        money_text("avg_order_value", grouped=False).alias("avg_order_value"),
        percent_text("conversion_rate").alias("conversion_rate"),
        percent_text("abandonment_rate").alias("abandonment_rate"),
        number_text("total_orders", 0).alias("total_orders"),
        number_text("total_sessions", 0).alias("total_sessions"),
    )


#: Metrics of the briefing that are money, and that are neither whole nor rates.
MONEY_METRICS, PLAIN_METRICS = ("total_spend_usd", "arpu"), ("avg_sessions_per_user",)


def briefing_text(tables: AppTables) -> DataFrame:
    """``briefing_context`` with every value as the text of its kind: money,
    percent (rates and gaps in points), or a count."""
    metric, value = F.col("metric"), F.col("value")
    text = (
        F.when(metric.isin(*MONEY_METRICS), money_text(value))
        .when(metric.endswith("_pct") | metric.endswith("_pts"), percent_text(value))
        .when(metric.isin(*PLAIN_METRICS), number_text(value))
        .otherwise(number_text(value, 0))
    )
    return briefing_context(tables).select("section", "entity", "metric", text.alias("value_text"))


#: The dashboard's column labels.
DISPLAY_NAMES = {
    "funnel_sessions": {
        "funnel_stage": "Funnel Stage",
        "session_volume": "Session Volume",
        "step_conversion_pct": "Step Conversion %",
        "step_dropoff_pct": "Step Drop-off %",
        "overall_completion_pct": "Overall Completion %",
    },
    "retention_by_channel": {
        "acquisition_channel": "Acquisition Channel",
        "cohort_size": "Cohort Size",
        "day1_active_users": "Day 1 Active Users",
        "day1_retention_pct": "Day 1 Retention %",
        "day7_active_users": "Day 7 Active Users",
        "day7_retention_pct": "Day 7 Retention %",
    },
    "segment_performance": {
        "user_segment": "User Segment",
        "user_count": "User Count",
        "total_sessions": "Total Sessions",
        "avg_sessions_per_user": "Avg Sessions per User",
        "total_spend_usd": "Total Spend USD",
        "arpu": "Average Revenue per User (ARPU)",
    },
    "ab_results": {
        "experiment_group": "Experiment Group",
        "checkout_sessions": "Checkout Sessions",
        "purchase_sessions": "Purchase Sessions",
        "conversion_rate_pct": "Conversion Rate %",
    },
}


def with_display_names(df: DataFrame, report: str) -> DataFrame:
    """Rename a report's columns to the dashboard labels."""
    mapping = DISPLAY_NAMES.get(report, {})
    return df.select(*[F.col(c).alias(mapping.get(c, c)) for c in df.columns])
