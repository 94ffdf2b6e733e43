"""Epoch conversions. Zero, negative and missing values give null everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offsets between epochs, in the unit named.
FILETIME_OFFSET_US = 11_644_473_600_000_000
APPLE_OFFSET_S = 978_307_200


def _micros(us: Column) -> Column:
    return F.timestamp_micros(us.try_cast("long"))


def from_filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601; zero, negative or past the year 2200 is not plausible."""
    us = F.call_function("div", ticks, F.lit(10)) - F.lit(FILETIME_OFFSET_US)
    return F.when((ticks > 0) & (us < 7_258_118_400_000_000), _micros(us))


def is_whole_second(ticks: Column) -> Column:
    return (ticks > 0) & (ticks % 10_000_000 == 0)


def from_webkit(us: Column) -> Column:
    return F.when(us > 0, _micros(us - F.lit(FILETIME_OFFSET_US)))


def from_unix_micros(us: Column) -> Column:
    return F.when(us > 0, _micros(us))


def from_unix_seconds(s: Column) -> Column:
    return F.when(s > 0, _micros(F.round(s.try_cast("double") * 1_000_000)))


def from_apple_seconds(s: Column) -> Column:
    return F.when(s > 0, _micros(F.round((s.try_cast("double") + APPLE_OFFSET_S) * 1_000_000)))


def from_apple_mixed(v: Column) -> Column:
    """Seconds since 2001, or nanoseconds when the number is too large for seconds."""
    seconds = F.when(v > 100_000_000_000, v.try_cast("double") / 1e9).otherwise(v.try_cast("double"))
    return from_apple_seconds(seconds)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)
