"""Exact distinct users that can be merged.

A count of distinct users per day says nothing about the week: users come back.
Here the users of a device on a day are kept as bitmaps, one bit a user and one
bitmap for every 32,768 consecutive ids, for each stage they reached. Bitmaps of
several days merge by OR, so the funnel of any range of days comes from the
stored ones alone, exactly, without the sessions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import flags
from tidemark.sources import schemas

STAGE_KEYS = schemas.STAGE_KEYS


def _bits(stage_key: str) -> str:
    return f"b_{stage_key}"


def daily_stage_bitmaps(mart: DataFrame) -> DataFrame:
    """day, device_type, bucket, and per stage the bitmap of its users, from the
    session mart. A device without a stage has an empty bitmap there."""
    bit = F.bitmap_bit_position("user_id")
    return (
        mart.filter(F.col("user_id").isNotNull())
        .groupBy(F.col("session_date").alias("day"), "device_type", F.bitmap_bucket_number("user_id").alias("bucket"))
        .agg(*[F.bitmap_construct_agg(F.when(F.col(flags.has_col(k)) > 0, bit)).alias(_bits(k)) for k in STAGE_KEYS])
    )


def between(bitmaps: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """The bitmaps of a range of days, both included."""
    return bitmaps.filter(F.col("day").between(F.lit(first), F.lit(last)))


def merged(bitmaps: DataFrame, *keys: Column | str) -> DataFrame:
    """Bitmaps by ``keys`` and bucket, over all days of each."""
    return bitmaps.groupBy(*keys, "bucket").agg(*[F.bitmap_or_agg(_bits(k)).alias(_bits(k)) for k in STAGE_KEYS])


def distinct_users(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Users per ``keys`` and stage (a column each), of merged bitmaps: a bucket's
    bits stand for users of that bucket alone."""
    return bitmaps.groupBy(*keys).agg(*[F.sum(F.bitmap_count(_bits(k))).alias(k) for k in STAGE_KEYS])
