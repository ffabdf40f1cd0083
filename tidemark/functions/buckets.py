"""Time buckets: tumbling windows with a step and a phase, and the grid they lie on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
#: Weeks begin on a Monday; the epoch was a Thursday.
MONDAY = 4 * 86400
NAMED = {"minute": 60, "five_minute": 300, "ten_minutes": 600, "fifteen_minutes": 900, "hour": 3600, "day": 86400}


def floor_to(seconds: Column, step: int, phase: int = 0) -> Column:
    """Start of the bucket, also before 1970."""
    return seconds - F.pmod(seconds - phase, F.lit(step))


def ceil_to(seconds: Column, step: int, phase: int = 0) -> Column:
    return seconds + F.pmod(phase - seconds, F.lit(step))


def bucket(ts: Column, n: int, unit: str) -> Column:
    """Start of the interval of n units as a timestamp; weeks begin on Monday."""
    step = n * UNITS[unit]
    return F.timestamp_seconds(floor_to(F.unix_seconds(ts.cast("timestamp")), step, MONDAY if unit == "week" else 0)).cast("timestamp_ntz")


def monday(ts: Column) -> Column:
    return bucket(ts, 1, "week")


def int_div(ts: Column, n: int, multiplier: int = 1) -> Column:
    """Unix time floored to n seconds, in units of 1/multiplier seconds."""
    return floor_to(F.unix_seconds(ts.cast("timestamp")), n) * multiplier


def in_range(ts: Column, start: str, end: str) -> Column:
    """Half-open range on the raw column, which Parquet filters and partitions can use."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))
