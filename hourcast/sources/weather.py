"""Landed hourly JSON blocks of parallel arrays."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import (FORECAST_COLS, FORECAST_JSON, FORECAST_RENAME, HOURLY_JSON, LEAD_DAYS,
                      WEATHER_COLS, WEATHER_RENAME)


def _parsed(raw: DataFrame, schema, body: str) -> DataFrame:
    """Blocks as structs; a block without its time axis is an error."""
    block = F.from_json(F.col(body), schema)
    time = F.col("_b.hourly.time")
    bad = F.raise_error(F.concat(F.lit("hourly block without 'time': "), F.substring(F.col(body), 1, 80)))
    checked = F.when(time.isNull(), bad.cast("array<string>")).otherwise(time)
    return raw.select(block.alias("_b"), body).withColumn("_time", checked)


def _local(text: Column) -> Column:
    return F.to_timestamp(text).cast("timestamp_ntz")


def observed_weather(raw: DataFrame, body: str = "value") -> DataFrame:
    """(zone, time, 11 canonical columns): one row per hour of each block."""
    b = _parsed(raw, HOURLY_JSON, body)
    # A variable the block does not carry is an empty array, which zips to nulls.
    rows = F.arrays_zip(F.col("_time").alias("time"),
                        *[F.coalesce(F.col(f"_b.hourly.{v}"), F.array().cast("array<double>")).alias(c)
                          for v, c in WEATHER_RENAME.items()])
    return (b.select(F.col("_b.zone").alias("zone"), F.explode(rows).alias("_e"))
            .select("zone", _local(F.col("_e.time")).alias("time"),
                    *[F.col(f"_e.{c}").alias(c) for c in WEATHER_COLS]))


def forecast_wide(raw: DataFrame, body: str = "value") -> DataFrame:
    """(zone, time, ``{var}_previous_day{n}`` as text) rows of forecast blocks."""
    b = _parsed(raw, FORECAST_JSON, body)
    names = [f"{v}_previous_day{d}" for d in LEAD_DAYS for v in FORECAST_RENAME]
    rows = F.arrays_zip(F.col("_time").alias("time"), *[
        F.coalesce(F.col(f"_b.hourly.{n}"), F.array().cast("array<string>")).alias(n) for n in names])
    return (b.select(F.col("_b.zone").alias("zone"), F.explode(rows).alias("_e"))
            .select("zone", _local(F.col("_e.time")).alias("time"), *[F.col(f"_e.{n}").alias(n) for n in names]))


def reshape_forecast(wide: DataFrame) -> DataFrame:
    """One row per (zone, valid_local, lead_day), with the date the forecast was issued.

    Text that is no number becomes null. A lead that is null throughout a zone lies outside the
    archive and gives no rows.
    """
    zero = F.lit(None).cast("double")

    def value(v: str, lead: int) -> Column:
        name = f"{v}_previous_day{lead}"
        return F.expr(f"try_cast(`{name}` AS double)") if name in wide.columns else zero

    leads = [F.struct(F.lit(d).alias("lead_day"), *[value(v, d).alias(c) for v, c in FORECAST_RENAME.items()])
             for d in LEAD_DAYS]
    long = (wide.select("zone", F.col("time").alias("valid_local"), F.explode(F.array(*leads)).alias("_e"))
            .select("zone", "valid_local", "_e.*"))
    known = long.groupBy("zone", "lead_day").agg(
        F.max(F.coalesce(*[F.col(c) for c in FORECAST_COLS]).isNotNull()).alias("_any"))
    kept = long.join(known.where("_any").drop("_any"), ["zone", "lead_day"], "left_semi")
    issue = F.date_sub(F.to_date("valid_local"), F.col("lead_day"))
    return kept.select("zone", issue.alias("issue_date"), "lead_day", "valid_local", *FORECAST_COLS)
