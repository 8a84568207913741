"""Prior-order counts per session.

How many orders a session's user had placed on earlier days. Asked per session
this is a correlated count, which Spark either rejects (in a grouped query) or
plans as a join of all sessions with all orders of the user.

Tables with a rollup have the number of orders on every session, so the answer
is a sum over the rows of the user's earlier days: one window over the rollup,
no second pass over events and no join (``with_prior_orders``). Its partitions
hold a user's sessions, one per active day, so they are bounded by the calendar
span, not by the user's events.

Where sessions and orders are stored apart, orders are counted per (user, day);
the distinct session days of each user join that with weight 0; a running sum
over the user's *days* (strictly before the current day) gives the count, which
joins back to sessions on (user_id, session_date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_prior_orders(rollup: DataFrame) -> DataFrame:
    """``rollup`` with past_purchases_count: the orders (``n_orders``) of the
    user's sessions on strictly earlier days."""
    earlier = Window.partitionBy("user_id").orderBy(F.unix_date("session_date")).rangeBetween(Window.unboundedPreceding, -1)
    return rollup.withColumn("past_purchases_count", F.coalesce(F.sum("n_orders").over(earlier), F.lit(0)).cast("bigint"))


def prior_order_counts_by_day(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """(user_id, session_date, past_purchases_count) for every distinct
    session or order day of a user: orders dated strictly before that day."""
    order_days = orders.groupBy("user_id", F.col("order_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    session_days = sessions.select("user_id", F.col("session_date").alias("day")).distinct().select(
        "user_id", "day", F.lit(0).cast("bigint").alias("n")
    )
    per_day = session_days.unionByName(order_days).groupBy("user_id", "day").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    with_prior = per_day.select(
        "user_id", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("past_purchases_count")
    )
    return with_prior.withColumnRenamed("day", "session_date")


def past_purchases(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Per session: session_id, user_id, session_date, past_purchases_count.
    Same-day orders are not counted (strict ``<``)."""
    per_day = prior_order_counts_by_day(sessions, orders)
    return sessions.select("session_id", "user_id", "session_date").join(
        per_day, ["user_id", "session_date"], "left"
    ).select(
        "session_id",
        "user_id",
        "session_date",
        F.coalesce(F.col("past_purchases_count"), F.lit(0)).cast("bigint").alias("past_purchases_count"),
    )
