"""Wall-clock time as exact integer microseconds.

All interval arithmetic runs on BIGINT microseconds of the naive local wall
clock (TIMESTAMP_NTZ), so sums are exact and independent of their order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayloom.vocab import LOCAL_TIMEZONE

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def to_us(ts) -> Column:
    """Microseconds since the epoch of a naive timestamp (session zone is UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def from_us(us) -> Column:
    """Inverse of :func:`to_us`."""
    return F.timestamp_micros(F.col(us) if isinstance(us, str) else us).cast("timestamp_ntz")


def floor_div(us: Column, width: int) -> Column:
    """Integer bin number, rounding towards minus infinity."""
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("bigint")


def minutes(us: Column) -> Column:
    """Microseconds to minutes."""
    return us / F.lit(float(MINUTE_US))


def normalize_timestamp(value, zone: str = LOCAL_TIMEZONE) -> Column:
    """B1: zone-aware values become naive local time, naive ones stay as they are.

    Takes a TIMESTAMP (aware), TIMESTAMP_NTZ (naive) or STRING column; text with
    a ``Z`` or ``+hh:mm`` suffix is aware. Bad text gives NULL.
    """
    c = F.col(value) if isinstance(value, str) else value
    text = F.trim(c.cast("string"))
    aware = text.rlike(r"[0-9]([Zz]|[+-][0-9]{2}:?([0-9]{2})?)$") & text.contains(":")
    instant = F.try_to_timestamp(text).cast("timestamp_ntz")
    return F.when(aware, F.convert_timezone(F.lit("UTC"), F.lit(zone), instant)).otherwise(instant)


def normalize_instant(value, zone: str = LOCAL_TIMEZONE) -> Column:
    """B1 for a column that already is a TIMESTAMP (an instant)."""
    c = F.col(value) if isinstance(value, str) else value
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))
