"""Numbers, dates and times as the text that people read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.metrics import _col


def number_text(value: Column | str, decimals: int = 2, grouped: bool = True) -> Column:
    """``1,234.50``, or without separators ``1234.50``; NULL stays NULL."""
    text = F.format_number(_col(value), decimals)
    return text if grouped else F.replace(text, F.lit(","), F.lit(""))


def money_text(value: Column | str, grouped: bool = True) -> Column:
    """``$1,234.50``."""
    return F.concat(F.lit("$"), number_text(value, 2, grouped))


def percent_text(value: Column | str, decimals: int = 2) -> Column:
    """``12.34%``."""
    return F.concat(number_text(value, decimals, grouped=False), F.lit("%"))


def with_text_times(df: DataFrame) -> DataFrame:
    """``df`` with its dates as ``2024-01-31`` and its times as
    ``2024-01-31 08:05:00``, to the second."""
    shown = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            shown.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            shown.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            shown.append(F.col(f.name))
    return df.select(*shown)
