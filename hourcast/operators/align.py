"""Bring metered load, preliminary load and weather onto one UTC clock."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import day_hours, local_of, local_status, utc_of
from ..session import require_utc
from ..sources.tables import stage
from .chunks import keep_first
from .quality import add_calendar, fill_forward_back


def to_utc(df: DataFrame, col: str, tz: str, keys: Sequence[str] = ("zone",),
           order: Sequence[str | Column] | None = None, on_ambiguous: str = "drop") -> DataFrame:
    """Wall-clock column -> ``ts_utc``; hours the clock skips or repeats are dropped.

    ``on_ambiguous='earliest'`` keeps a repeated hour as its first instant instead. Duplicates of
    one instant keep the first by ``order``, then by all other columns, so the survivor does not
    depend on the order of the rows.
    """
    require_utc(df.sparkSession)
    status = local_status(F.col(col), tz)
    keep = status == "ok" if on_ambiguous == "drop" else status != "nonexistent"
    out = df.where(keep).withColumn("ts_utc", utc_of(F.col(col), tz))
    ties = [c for c in df.columns if c not in keys]
    return keep_first(out, [*keys, "ts_utc"], [*(order or [col]), *ties])


def to_local(df: DataFrame, tz: str, col: str = "ts_utc", out: str = "ts_local") -> DataFrame:
    """UTC -> wall clock column."""
    return df.withColumn(out, local_of(F.col(col), tz))


def join_loads(metered: DataFrame, preliminary: DataFrame | None, tz: str) -> DataFrame:
    """Full outer join on (zone, hour): the recent hours with a preliminary load only stay, and
    their missing wall clock is derived from UTC."""
    if preliminary is None:
        joined = metered
    else:
        joined = metered.join(preliminary, ["zone", "ts_utc"], "full")
    return joined.withColumn("ts_local", F.coalesce("ts_local", local_of(F.col("ts_utc"), tz)))


def join_weather(loads: DataFrame, weather: DataFrame, tz: str, time_col: str = "time") -> DataFrame:
    """Left join of local-time weather onto the loads, by UTC hour."""
    return loads.join(to_utc(weather, time_col, tz).drop(time_col), ["zone", "ts_utc"], "left")


def align(metered: DataFrame, preliminary: DataFrame | None, weather: DataFrame, tz: str,
          time_col: str = "time", max_gap: int | None = None, staged: bool = False) -> DataFrame:
    """One hourly frame: loads joined, weather left-joined and filled forward, then back.

    Filling reads the joined rows twice; ``staged`` writes them once instead of joining twice.
    """
    joined = join_weather(join_loads(metered, preliminary, tz), weather, tz, time_col)
    if staged:
        joined = stage(joined, "joined")
    weather_cols = [c for c in weather.columns if c not in ("zone", "ts_utc", time_col)]
    return fill_forward_back(joined, weather_cols, max_gap)


def local_day_hours(days: DataFrame, tz: str, day: str = "target_day") -> DataFrame:
    """The 23, 24 or 25 real hours of each day: adds ts_utc, ts_local and hour."""
    start = utc_of(F.col(day).cast("timestamp_ntz"), tz)
    last = day_hours(F.col(day), tz) - 1
    hours = F.explode(F.sequence(F.lit(0), last))
    return (days.withColumn("_k", hours)
            .withColumn("ts_utc", F.timestamp_seconds(F.unix_seconds(start) + F.col("_k") * 3600))
            .withColumn("ts_local", local_of(F.col("ts_utc"), tz))
            .withColumn("hour", F.hour("ts_local")).drop("_k"))


def extend_future(df: DataFrame, days: int, tz: str) -> DataFrame:
    """Append calendar-only rows for the ``days`` local days after each zone's last complete one;
    hours already present win. Load and weather of the new rows are null."""
    from .quality import complete_days
    last = complete_days(df, tz).groupBy("zone").agg(F.max("local_date").alias("_last"))
    ahead = last.select("zone", F.explode(F.sequence(F.date_add("_last", 1),
                                                     F.date_add("_last", days))).alias("target_day"))
    rows = local_day_hours(ahead, tz).select("zone", "ts_utc", "ts_local")
    new = add_calendar(rows.join(df.select("zone", "ts_utc"), ["zone", "ts_utc"], "left_anti"))
    shared = [c for c in new.columns if c in df.columns]
    return df.unionByName(new.select(*shared), allowMissingColumns=True)


def day_type(day: Column, tz: str) -> Column:
    """'spring_forward', 'fall_back' or null."""
    n = day_hours(day, tz)
    return F.when(n == 23, "spring_forward").when(n == 25, "fall_back")


def expand_to_real_hours(pred: DataFrame, tz: str, value: str = "yhat") -> DataFrame:
    """24-slot arrays -> one row per real hour of the target day, by clock hour."""
    hours = local_day_hours(pred, tz)
    return hours.withColumn(value, F.col(value)[F.col("hour")])
