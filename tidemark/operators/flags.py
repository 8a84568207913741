"""Stage counts and any-match flags.

``COUNT(DISTINCT CASE WHEN type = t THEN key END)`` for six stages makes
Spark expand every row six times (``Expand`` in the plan). Counting the events
of each stage per entity in one algebraic aggregation, then summing 0/1 flags,
gives the same numbers from a single map-side-combined shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import schemas


def n_col(stage_key: str) -> str:
    return f"n_{stage_key}"


def has_col(stage_key: str) -> str:
    return f"has_{stage_key}"


COUNT_COLS = [n_col(k) for k in schemas.STAGE_KEYS] + ["n_events"]


def stage_count_aggs(type_col: str = "event_type") -> list[Column]:
    """Aggregate expressions: events of each stage (``n_<stage>``) and of all
    types (``n_events``)."""
    aggs = [
        F.count_if(F.col(type_col) == F.lit(stage)).alias(n_col(key))
        for stage, key in zip(schemas.STAGES, schemas.STAGE_KEYS)
    ]
    aggs.append(F.count(F.lit(1)).alias("n_events"))
    return aggs


def stage_counts(events: DataFrame, *keys: str, type_col: str = "event_type") -> DataFrame:
    """Per ``keys``: the number of events of each stage and of all events."""
    return events.groupBy(*keys).agg(*stage_count_aggs(type_col))


def has_flag(stage_key: str) -> Column:
    """1 when the entity has at least one event of the stage, else 0 (NULL
    counts from an outer join count as 0)."""
    return (F.coalesce(F.col(n_col(stage_key)), F.lit(0)) > 0).cast("int")
