"""Time: instants in microseconds, buckets, window texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit letters of a window text, in seconds, and the default of
# seven days that stands for every text that cannot be read.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
DEFAULT_WINDOW_SECONDS = 604800

# Longer than the calendar: a longer window finds nothing more.
LONGEST_WINDOW_SECONDS = 10_000 * 366 * 86400

# Bounds that the query API fills in for a caller who names none. The
# operators themselves take a missing bound as open.
DEFAULT_FROM = "2000-01-01"
DEFAULT_TO = "2099-12-31"

# The epoch milliseconds that are a valid instant.
MIN_EPOCH_MS = -8640000000000000
MAX_EPOCH_MS = 8640000000000000

GRAINS = ("minute", "hour", "day")


def micros(ts: Column) -> Column:
    """Instant as epoch microseconds; zone-less timestamps are read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def bucket(ts: Column, grain: str) -> Column:
    """Start of the minute, hour, day or week, without a zone."""
    return F.date_trunc(grain, ts).cast("timestamp_ntz")


def next_bucket(ts: Column, grain: str) -> Column:
    """Start of the first minute, hour or day that does not begin before the instant."""
    start = bucket(ts, grain)
    return F.when(start < ts, start + F.expr(f"interval 1 {grain}")).otherwise(start)


def week_of(ts: Column) -> Column:
    """Monday of the week as a date."""
    return F.date_trunc("week", ts).cast("date")


def slot(value: Column, width: int) -> Column:
    """Index of the half-open interval of `width` that holds an integer value.

    Whole-number arithmetic, so it is exact before the epoch as well.
    """
    step = F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, step), step)


def granularity(text: str | None) -> str:
    """Unknown granularities mean hour."""
    return text if text in GRAINS else "hour"


def parse_window(text: str | None) -> int:
    """Seconds of a text such as ``7d``; unreadable or zero means seven days."""
    match = re.fullmatch(r"([0-9]+)([smhd])", text or "")
    if not match or int(match.group(1)) <= 0:
        return DEFAULT_WINDOW_SECONDS
    seconds = int(match.group(1)) * UNIT_SECONDS[match.group(2)]
    return min(seconds, LONGEST_WINDOW_SECONDS)


def parse_window_column(text: Column) -> Column:
    """`parse_window` for a column of texts."""
    number = F.regexp_extract(text, r"^([0-9]+)([smhd])\z", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"^([0-9]+)([smhd])\z", 2)
    factor = F.lit(None).cast("bigint")
    for letter, seconds in UNIT_SECONDS.items():
        factor = F.when(unit == letter, F.lit(seconds)).otherwise(factor)
    longest = F.lit(LONGEST_WINDOW_SECONDS)
    seconds = F.least(F.least(number, longest) * factor, longest)
    return F.coalesce(F.when(number > 0, seconds), F.lit(DEFAULT_WINDOW_SECONDS)).cast("bigint")
