"""Epoch numbers held in strings, display forms and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text_basics import as_col, leading_int

# Unit border, retry and schedule limits.
MILLIS_ABOVE = 1_000_000_000_000
BACKOFF_BASE_MS = 1_000
BACKOFF_CAP_MS = 8_000
MAX_RETRIES = 3
DEFAULT_QPS = 2
MIN_SCHEDULE_MINUTES = 5
UNIT_MS = {"minutes": 60_000, "hours": 3_600_000, "days": 86_400_000}


def to_seconds(timestamp: Column | str) -> Column:
    """Seconds from a string that may hold seconds or milliseconds; 0 if unknown."""
    number = leading_int(as_col(timestamp).cast("string"))
    return (
        F.when(number.isNull() | (number <= 0), F.lit(0).cast("bigint"))
        .when(number > MILLIS_ABOVE, F.floor(number / 1000))
        .otherwise(number)
    )


def seconds_to_iso(seconds: Column | str) -> Column:
    seconds = F.coalesce(as_col(seconds), F.lit(0))
    shown = F.date_format(F.timestamp_seconds(seconds), "y-MM-dd'T'HH:mm:ss")
    return F.when(seconds == 0, F.lit("")).otherwise(shown)


def timestamp_to_iso(timestamp: Column | str) -> Column:
    return seconds_to_iso(to_seconds(timestamp))


def millis_to_date(millis: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(as_col(millis)), "y-MM-dd")


def retry_delay_ms(attempt: Column | str, base: int = BACKOFF_BASE_MS, cap: int = BACKOFF_CAP_MS) -> Column:
    """Delay before a retry: doubles per attempt up to the cap."""
    return F.least(F.lit(base) * F.pow(F.lit(2), as_col(attempt) - 1), F.lit(cap)).cast("bigint")


def clamp_schedule(value: float, unit: str) -> tuple[float, bool]:
    """Shortest allowed interval; only the minutes unit is clamped."""
    if unit == "minutes" and value < MIN_SCHEDULE_MINUTES:
        return MIN_SCHEDULE_MINUTES, True
    return value, False


def schedule_ms(value: float, unit: str) -> int:
    return max(1, int(value // 1)) * UNIT_MS[unit]


def schedule_interval(value: Column | str, unit: Column | str) -> tuple[Column, Column]:
    """Milliseconds between two runs of a schedule, and whether its value was raised to the minimum."""
    wanted, named = as_col(value), as_col(unit)
    clamped = (named == "minutes") & (wanted < MIN_SCHEDULE_MINUTES)
    whole = F.greatest(F.floor(F.when(clamped, MIN_SCHEDULE_MINUTES).otherwise(wanted)), F.lit(1))
    per_unit = F.create_map(*[F.lit(x) for pair in UNIT_MS.items() for x in pair])
    return (whole * per_unit[named]).cast("bigint"), clamped
