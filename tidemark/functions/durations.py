"""Durations, steps, times and scalars of query parameters, on the driver; grids and ranges of points by them."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.buckets import floor_to

#: Nanoseconds of a unit; a month is 730 hours.
UNITS = {
    "mo": 730 * 3600 * 10**9, "ms": 10**6, "us": 1000, "\u00b5s": 1000, "\u03bcs": 1000, "ns": 1, "y": 8760 * 3600 * 10**9, "w": 7 * 86400 * 10**9,
    "d": 86400 * 10**9, "h": 3600 * 10**9, "m": 60 * 10**9, "s": 10**9, "u": 1000, "\u00b5": 1000, "\u03bc": 1000,
}
_UNIT = "|".join(UNITS)
_LIMIT = 1 << 63


class QueryRangeExceeded(ValueError):
    """A query asks for a longer range than allowed."""


def parse_duration(text: str) -> int:
    """Nanoseconds of '1h30m', '2d', '-5m', '1.5h'; fractions only with units up to an hour. ValueError where it isn't one."""
    small = re.fullmatch(r"([+-]?)((?:(?:\d+\.?\d*|\.\d+)(?:ns|us|\u00b5s|\u03bcs|ms|s|m|h))+|0)", text)
    if small:
        total = sum(_exact(n, UNITS[u]) for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|\u00b5s|\u03bcs|ms|s|m|h)", small[2]))
        total = -total if small[1] == "-" else total
    elif re.fullmatch(rf"(?:[+-]?\d+(?:{_UNIT}))+", text):
        total = sum(int(n) * UNITS[u] for n, u in re.findall(rf"([+-]?\d+)({_UNIT})", text))
    else:
        raise ValueError(f"no duration: {text!r}")
    if not -_LIMIT <= total < _LIMIT:
        raise ValueError(f"duration out of range: {text!r}")
    return total


def _exact(number: str, unit: int) -> int:
    whole, _, part = number.partition(".")
    return int(whole or 0) * unit + (int(part) * unit // 10 ** len(part) if part else 0)


def parse_step(text: str) -> int:
    """Nanoseconds of a step: seconds, cut to whole ones, or a duration."""
    try:
        return int(float(text)) * 10**9
    except ValueError:
        return parse_duration(text)


def parse_time(text: str) -> int:
    """Nanoseconds of unix seconds, rounded to milliseconds, or of an RFC 3339 time."""
    try:
        part, whole = math.modf(float(text))
        return int(whole) * 10**9 + round(part * 1000) * 10**6
    except ValueError:
        pass
    t = datetime.fromisoformat(text)
    if t.tzinfo is None:
        raise ValueError(f"no time: {text!r}")
    since = t - datetime(1970, 1, 1, tzinfo=UTC)
    return (since.days * 86400 + since.seconds) * 10**9 + since.microseconds * 1000


def scalar_literal(text: str) -> float | None:
    """A number of an aggregation's parameter: NaN, infinities, decimal, hexadecimal, octal by a leading zero, or a duration in seconds; else None."""
    t = text.strip()
    low = t.lower()
    if re.fullmatch(r"[+-]?nan", low):
        return math.nan
    if re.fullmatch(r"[+-]?inf", low):
        return -math.inf if low[0] == "-" else math.inf
    sign, body = (-1.0 if t[:1] == "-" else 1.0), t[1:] if t[:1] in ("+", "-") else t
    if re.fullmatch(r"0[0-7]+", body):
        return sign * int(body, 8)
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", body):
        return sign * int(body, 16)
    if re.fullmatch(r"\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?", body):
        return sign * float(body)
    if re.fullmatch(r"(?:\d+y)?(?:\d+w)?(?:\d+d)?(?:\d+h)?(?:\d+m)?(?:\d+s)?(?:\d+ms)?", body) and body:
        return sign * parse_duration(body) / 1e9
    return None


def minutes(start: Column, end: Column) -> tuple[Column, Column]:
    """Seconds on whole minutes: starts down, ends up."""
    return floor_to(start, 60), floor_to(end + 59, 60)


def instant(at: Column, every: int = 15) -> Column:
    """Seconds of an instant query on a grid of ``every`` seconds."""
    return floor_to(at, every)


def check_range(start: int, end: int, longest: int) -> None:
    """Raises QueryRangeExceeded where a range is longer than ``longest``; 0 allows any."""
    if longest and end - start > longest:
        raise QueryRangeExceeded(f"range of {end - start} exceeds {longest}")


def checked(requests: DataFrame, longest: int) -> DataFrame:
    """Requests (start, end) with the column allowed."""
    return requests.withColumn("allowed", F.lit(longest == 0) | (F.col("end") - F.col("start") <= longest))


def bounded(points: DataFrame, ts: str, now: int, step: int) -> DataFrame:
    """An open-ended query's points before the bucket of ``now``, which isn't whole yet."""
    return points.filter(F.col(ts) < F.timestamp_seconds(F.lit(now - now % step)).cast("timestamp_ntz"))


def grid(requests: DataFrame, step: int) -> DataFrame:
    """Each request's evaluation times start, start + step, ... up to its end, as column at."""
    return requests.withColumn("at", F.explode(F.sequence("start", "end", F.lit(step))))


def evaluate(points: DataFrame, start: int, end: int, step: int, lookback: int, at: str = "at", value: str = "v", series: str = "series") -> DataFrame:
    """The newest value of each series at each evaluation time, not older than ``lookback``.

    A point goes to the few times it may answer, so no point meets another.
    """
    first = start + F.ceil(F.greatest(F.col(at) - start, F.lit(0)) / step) * step
    last = F.least(F.col(at) + (lookback - 1), F.lit(end))
    reached = points.filter(F.col(at).between(start - lookback + 1, end)).withColumn("_to", last).withColumn("_from", first).filter("_from <= _to")
    each = reached.withColumn("time", F.explode(F.sequence("_from", "_to", F.lit(step))))
    return each.groupBy(series, "time").agg(F.max_by(value, at).alias(value))
