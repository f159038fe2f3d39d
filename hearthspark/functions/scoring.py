"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def moment(as_of) -> Column:
    """The reference time of a job; nothing in the library reads the clock."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def age_days(when: Column, as_of) -> Column:
    """Whole elapsed days, rounded down (a future date gives a negative age)."""
    micros = F.timestamp_diff("MICROSECOND", when, moment(as_of))
    return F.floor(micros / F.lit(DAY_MICROS))


def freshness_bucket(days: Column) -> Column:
    return F.when(days <= 7, 1.0).when(days <= 30, 0.7).when(days <= 90, 0.4).otherwise(0.1)


def freshness_decay(days: Column) -> Column:
    known = F.greatest(F.coalesce(days, F.lit(365)), F.lit(0))
    return 1 / (1 + known / F.lit(30.0))


def popularity(views: Column, clicks: Column, leads: Column) -> Column:
    """The ETL's engagement score."""
    return views * 1.0 + clicks * 10.0 + leads * 50.0


def smart_popularity(impressions: Column, views: Column, favorites: Column, clicks: Column, leads: Column) -> Column:
    """The model's engagement score; its weights differ from ``popularity``."""
    return impressions * 0.01 + views * 1.0 + favorites * 5.0 + clicks * 15.0 + leads * 50.0


def relative(value: Column, largest: Column) -> Column:
    """value / largest; 0 where that is undefined."""
    return F.coalesce(F.try_divide(value, largest), F.lit(0.0))


def popularity_share(value: Column, largest: Column) -> Column:
    return F.when(largest > 0, F.log1p(value) / F.log1p(largest)).otherwise(0.0)


def safe_float(value: Column, places: int = 2) -> Column:
    """Rounded for display; null, NaN and infinities show as 0."""
    wrong = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(wrong, 0.0).otherwise(F.round(value, places))
