"""Declared schemas of the five-table app model (users, sessions, events,
orders, experiments) and the fixed value domains the reports rely on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference's for identical results) --------
# Funnel stages, in funnel order.
STAGES = ["App Open", "Search", "View Product", "Add To Cart", "Checkout", "Purchase"]
# Experiment groups and the experiment's feature name.
GROUP_A = "Group A (Old Checkout)"
GROUP_B = "Group B (New Checkout)"
EXPERIMENT_FEATURE = "Checkout Optimization"
# User segments.
SEGMENT_NEW = "New User"
SEGMENT_REPEAT = "Repeat User"
SEGMENT_DORMANT = "Dormant User"
# Device types.
DEVICES = ["iOS", "Android", "Web"]
# Product categories.
CATEGORIES = ["Electronics", "Fashion", "Home & Kitchen", "Beauty & Personal Care", "Sports & Outdoors"]
# Segment rule: New when signed up within the last 14 days of the window,
# otherwise Repeat with at least 3 active days, otherwise Dormant.
NEW_USER_WINDOW_DAYS = 14
REPEAT_MIN_ACTIVE_DAYS = 3
# Risk bands of the cart scorer (strict greater-than).
RISK_HIGH_ABOVE = 70.0
RISK_MEDIUM_ABOVE = 40.0
# Model quality gate.
GATE_MIN_ACCURACY = 0.80
GATE_MIN_F1 = 0.80
# ---------------------------------------------------------------------------

# Snake-case column names of the six stages, used for flag columns.
STAGE_KEYS = ["app_open", "search", "view_product", "add_to_cart", "checkout", "purchase"]


def _f(name: str, dtype: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, dtype, nullable)


USERS = T.StructType([
    _f("user_id", T.LongType()),
    _f("signup_date", T.DateType()),
    _f("city", T.StringType()),
    _f("acquisition_channel", T.StringType()),
    _f("user_segment", T.StringType()),
])

SESSIONS = T.StructType([
    _f("session_id", T.LongType()),
    _f("user_id", T.LongType()),
    _f("session_duration", T.LongType()),
    _f("device_type", T.StringType()),
    _f("session_date", T.DateType()),
    _f("discount_coupon_applied", T.IntegerType(), True),
])

EVENTS = T.StructType([
    _f("event_id", T.LongType()),
    _f("user_id", T.LongType()),
    _f("session_id", T.LongType()),
    _f("event_type", T.StringType()),
    _f("feature_name", T.StringType(), True),
    _f("timestamp", T.TimestampNTZType()),
])

ORDERS = T.StructType([
    _f("order_id", T.LongType()),
    _f("user_id", T.LongType()),
    _f("session_id", T.LongType()),
    _f("amount", T.DecimalType(10, 2)),
    _f("category", T.StringType()),
    _f("order_date", T.DateType()),
])

EXPERIMENTS = T.StructType([
    _f("experiment_id", T.LongType()),
    _f("user_id", T.LongType()),
    _f("experiment_group", T.StringType()),
    _f("feature_name", T.StringType()),
    _f("launch_date", T.DateType()),
])

TABLE_SCHEMAS: dict[str, T.StructType] = {
    "users": USERS,
    "sessions": SESSIONS,
    "events": EVENTS,
    "orders": ORDERS,
    "experiments": EXPERIMENTS,
}

# Primary keys and foreign keys as declared by the app model (checked by the
# integrity audit, never enforced on write).
PRIMARY_KEYS = {
    "users": "user_id",
    "sessions": "session_id",
    "events": "event_id",
    "orders": "order_id",
    "experiments": "experiment_id",
}
FOREIGN_KEYS = [
    # (child table, child column, parent table, parent column)
    ("sessions", "user_id", "users", "user_id"),
    ("events", "user_id", "users", "user_id"),
    ("events", "session_id", "sessions", "session_id"),
    ("orders", "user_id", "users", "user_id"),
    ("orders", "session_id", "sessions", "session_id"),
    ("experiments", "user_id", "users", "user_id"),
]
