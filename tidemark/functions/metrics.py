"""Column helpers shared by the reports.

All helpers return JVM-side expressions (no Python UDFs), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_ratio(num: Column | str, den: Column | str, scale: int = 1) -> Column:
    """``round(scale * num / den, 2)`` for non-negative integer counts, NULL
    when ``den`` is 0 or NULL.

    Computed in exact integer arithmetic with half-up rounding,
    ``((200 * scale * num + den) div (2 * den)) / 100``, so a tie such as
    100 * 1/32 always gives 3.13 whatever the binary value of 3.125 is.
    """
    n = _col(num).cast("bigint")
    d = F.nullif(_col(den).cast("bigint"), F.lit(0))
    x = F.lit(200 * scale) * n + d
    y = F.lit(2) * d
    # x - x % y is an exact multiple of y, so the division is exact.
    return ((x - x % y) / y) / F.lit(100.0)


def pct2(num: Column | str, den: Column | str) -> Column:
    """``round(100 * num / den, 2)`` for counts; NULL when ``den`` is 0."""
    return round_ratio(num, den, 100)


def signed_pct2(num: Column | str, den: Column | str) -> Column:
    """``pct2`` for a numerator that may be negative (drop-off from counts):
    the sign is applied to the rounded magnitude (half away from zero)."""
    n = _col(num).cast("bigint")
    return F.signum(n) * pct2(F.abs(n), den)


#: Money is summed in whole units of a ten-thousandth.
UNITS = 10_000


def money_units(amount: Column | str) -> Column:
    """A money amount as a whole number of ``UNITS``. Decimal amounts convert
    exactly, doubles by their four-decimal value, so totals don't depend on
    the order of summation and are rounded once, at the end."""
    return (_col(amount).cast("decimal(18,4)") * F.lit(UNITS)).cast("bigint")


def money(units: Column | str, count: Column | str | None = None) -> Column:
    """Units, or their mean over ``count``, as an amount rounded half-up to
    cents; NULL for no units or a count of 0. Decimal arithmetic throughout,
    so neither totals nor ties depend on a binary fraction."""
    n = _col(units).cast("decimal(28,0)")
    d = F.lit(UNITS).cast("decimal(28,0)")
    if count is not None:
        d = (F.nullif(_col(count).cast("bigint"), F.lit(0)) * F.lit(UNITS)).cast("decimal(28,0)")
    x, y = F.abs(n) * F.lit(200) + d, d * F.lit(2)
    rounded = ((x - x % y) / y).cast("double") / F.lit(100.0)
    return F.signum(n).cast("double") * rounded


#: What the dashboard's filters call no filter, by column.
ALL_OF = {"city": "All Regions", "acquisition_channel": "All Channels", "device_type": "All Devices"}


def none_if_all(column: str, value):
    """The filter value, or None for the column's word for everything."""
    return None if value == ALL_OF.get(column) else value


def optional_eq(df: DataFrame, column: str, value) -> DataFrame:
    """``WHERE (column = value OR value IS NULL)``: None and the column's word
    for everything (``ALL_OF``) mean no filter; any other value (including the
    empty string) is an equality filter.

    Resolved on the driver, so the plan carries either a plain pushed-down
    equality or nothing at all.
    """
    value = none_if_all(column, value)
    if value is None:
        return df
    return df.filter(F.col(column) == F.lit(value))
