"""The forecast archive: bitemporal, never flattened into the hourly frame."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from ..operators.chunks import keep_first
from ..schema import FORECAST_COLS, LEAD_DAYS

HOURS_PER_ISSUE = 24 * len(LEAD_DAYS)


def within_archive(fc: DataFrame, start: date, end: date, archive_start: date, as_of: date,
                   horizon_days: int = 2) -> DataFrame:
    """Rows whose valid day lies in [max(start, archive_start), min(end, as_of + horizon)]."""
    lo, hi = max(start, archive_start), min(end, as_of + timedelta(days=horizon_days))
    return fc.where(F.to_date("valid_local").between(F.lit(lo), F.lit(hi)))


def duplicate_count(fc: DataFrame) -> DataFrame:
    """(zone, n_duplicates): rows beyond the first per (valid hour, lead)."""
    cells = fc.groupBy("zone", "valid_local", "lead_day").agg(F.count(F.lit(1)).alias("_k"))
    return cells.groupBy("zone").agg(F.sum(F.col("_k") - 1).alias("n_duplicates"))


def clean_forecast(fc: DataFrame, order: Sequence[str] = ("file",)) -> DataFrame:
    """First row per (valid hour, lead) by ``order``, and ``is_complete`` per issue date.

    Reading every shard in one scan puts issue dates split at a year's end back together.
    """
    one = keep_first(fc, ["zone", "valid_local", "lead_day"], list(order))
    return flag_complete(one)


def flag_complete(fc: DataFrame) -> DataFrame:
    """``is_complete``: the issue date carries all 48 temperatures. Rows are kept either way."""
    hours = fc.groupBy("zone", "issue_date").agg(F.count("Temp_F").alias("_n"))
    return (fc.join(hours, ["zone", "issue_date"])
            .withColumn("is_complete", (F.col("_n") == HOURS_PER_ISSUE).cast("int")).drop("_n"))


def coverage(fc: DataFrame) -> DataFrame:
    """(zone, n_issue_dates, n_complete, n_partial, first_issue, last_issue, empty_columns)."""
    issue = fc.groupBy("zone", "issue_date").agg(
        F.count("Temp_F").alias("_t"), *[F.count(c).alias(c) for c in FORECAST_COLS if c in fc.columns])
    full = F.count_if(F.col("_t") == HOURS_PER_ISSUE)
    empty = [F.when(F.sum(c) == 0, F.lit(c)) for c in FORECAST_COLS if c in fc.columns]
    return issue.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_issue_dates"), full.alias("n_complete"),
        (F.count(F.lit(1)) - full).alias("n_partial"), F.min("issue_date").alias("first_issue"),
        F.max("issue_date").alias("last_issue"), F.array_compact(F.array(*empty)).alias("empty_columns"))


def ordered(fc: DataFrame) -> DataFrame:
    """By issue date, then through the 48 hours it covers."""
    return fc.orderBy("zone", "issue_date", "valid_local")
