"""Clocks: instants are TIMESTAMP, local wall-clock times are TIMESTAMP_NTZ."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_tz(df: DataFrame, column: str, local_tz: str | None) -> str | None:
    """The zone for a column: the given one; without one, a column of instants is read on the UTC clock, with a warning."""
    if local_tz is None and dict(df.dtypes).get(column) == "timestamp":
        warnings.warn(f"{column} holds instants and no local_tz is given: hours and days are read on the UTC clock", stacklevel=2)
    return local_tz


def local_clock(value: Column, kind: str, local_tz: str | None, assume_utc: bool = False) -> Column:
    """A TIMESTAMP_NTZ on the local clock. ``kind`` is the column's type name: instants (and, with ``assume_utc``, naive
    times) are converted from UTC; other naive times pass through. Strings are parsed first; bad ones give null."""
    if kind == "string":
        value, kind = F.try_to_timestamp(value), "timestamp"
    zone = local_tz or "UTC"
    if kind == "timestamp":
        return F.convert_timezone(F.current_timezone(), F.lit(zone), value.cast("timestamp_ntz"))
    value = value.cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), value) if assume_utc and local_tz else value


def in_window(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies in [start, end), across midnight if start > end."""
    return (hour >= start) | (hour < end) if start > end else (hour >= start) & (hour < end)


def overnight(start: Column, end: Column, from_hour: int = 20, to_hour: int = 7) -> Column:
    """Whether any full hour from floor(start) to ceil(end), both included, lies in the night window."""
    top = F.date_trunc("hour", end).cast("timestamp_ntz")
    top = F.when(top < end, top + F.expr("INTERVAL 1 HOUR")).otherwise(top)
    hours = F.sequence(F.date_trunc("hour", start).cast("timestamp_ntz"), top, F.expr("INTERVAL 1 HOUR"))
    return F.exists(hours, lambda h: in_window(F.hour(h), from_hour, to_hour))


def micros(value: Column) -> Column:
    """Microseconds of a timestamp of either kind (naive times as if UTC), for exact differences."""
    return F.unix_micros(value.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def delay_hours(departure: Column, order: Column) -> Column:
    """Signed hours from order to departure; strings are parsed, bad values give null."""
    return seconds_between(F.try_to_timestamp(order.cast("string")), F.try_to_timestamp(departure.cast("string"))) / F.lit(3600.0)
