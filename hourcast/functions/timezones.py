"""Wall clock <-> UTC as Column expressions.

Spark resolves an ambiguous or skipped wall-clock hour by picking one instant silently, so
``local_status`` names those hours and the callers drop them.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def local_of(ts: Column, tz: str) -> Column:
    """UTC instant -> wall clock (timestamp_ntz). The zone's name is read once, not for every row as ``convert_timezone`` does."""
    return F.from_utc_timestamp(ts.cast("timestamp"), tz).cast("timestamp_ntz")


def utc_of(local: Column, tz: str) -> Column:
    """Wall clock -> UTC instant, as a timestamp (session zone UTC)."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local.cast("timestamp_ntz")).cast("timestamp")


def local_status(local: Column, tz: str) -> Column:
    """'ok', 'nonexistent' (spring gap) or 'ambiguous' (autumn repeat) for a wall-clock hour."""
    wall = local.cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), wall)
    hour = F.expr("INTERVAL 1 HOUR")

    def back(u: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), u)

    return (F.when(back(utc) != wall, "nonexistent")
            .when((back(utc + hour) == wall) | (back(utc - hour) == wall), "ambiguous")
            .otherwise("ok"))


def day_hours(day: Column, tz: str) -> Column:
    """Real hours of a local calendar day: 23, 24 or 25."""
    start = utc_of(day.cast("timestamp_ntz"), tz)
    end = utc_of(F.date_add(day, 1).cast("timestamp_ntz"), tz)
    return F.floor((F.unix_seconds(end) - F.unix_seconds(start)) / 3600).cast("int")
