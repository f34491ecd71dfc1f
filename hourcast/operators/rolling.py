"""Causal hourly features and rolling statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cooling, heat_index, heating, wet_bulb

from .chunks import chunk_window, hour_number, with_halo, with_position

THERMAL_REACH = 72


def thermal_columns(base: float = 65.0, temp: str = "Temp_F",
                    rh: str = "RelativeHumidity_pct") -> tuple[dict[str, Column], dict[str, Column]]:
    """(row columns, window columns) of the thermal block; the windows run over ``chunk_window``."""
    t, h, w = F.col(temp), F.col(rh), chunk_window()

    def rows(n: int):
        return w.rowsBetween(1 - n, 0)

    row = {"CDD_h": cooling(t, base), "HDD_h": heating(t, base),
           "HeatIndex_F": heat_index(t, h), "WetBulb_F": wet_bulb(t, h)}
    window = {f"CDD_cum_{n}h": F.sum("CDD_h").over(rows(n)) for n in (24, 48, 72)}
    window |= {f"Temp_ma_{n}h": F.avg(temp).over(rows(n)) for n in (24, 72)}
    window["Temp_delta_24h"] = F.coalesce(t - F.lag(temp, 24).over(w), F.lit(0.0))
    return row, window


def add_thermal_sequence(df: DataFrame, base: float = 65.0, position: str = "rank") -> DataFrame:
    """All ten thermal sequence columns with one sort per chunk."""
    row, window = thermal_columns(base)
    had_pos = "pos" in df.columns
    out = (with_halo(with_position(df.withColumns(row), position), THERMAL_REACH)
           .withColumns(window).where("is_home").drop("chunk", "is_home"))
    return out if had_pos else out.drop("pos")


def rolling_time_mean(df: DataFrame, cols: dict[str, Column], days: int = 7, ts: str = "ts_utc",
                      by: tuple[str, ...] = ("zone",)) -> DataFrame:
    """Mean over the time range (t - days, t]; a null row is not counted.

    The range is bounded, so each chunk only needs the ``days`` before it, whatever the holes.
    """
    hours = 24 * days
    tagged = df.withColumn("_hour", hour_number(F.col(ts)))
    w = (W.partitionBy(*by, "chunk").orderBy(F.col("_us"))
         .rangeBetween(-(days * 86_400_000_000) + 1, 0))
    halo = with_halo(tagged, hours, pos="_hour").withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return (halo.withColumns({name: F.avg(c).over(w) for name, c in cols.items()})
            .where("is_home").drop("chunk", "is_home", "_hour", "_us"))


def daily_temperature(df: DataFrame, temp: str = "Temp_F", train: Column | None = None) -> DataFrame:
    """Local daily mean temperature over present days; ``is_train`` if any of its rows is."""
    aggs = [F.avg(temp).alias("temp_mean")]
    if train is not None:
        aggs.append(F.bool_or(train).alias("is_train"))
    return df.groupBy("zone", F.to_date("ts_local").alias("local_date")).agg(*aggs)


def heat_streak(daily: DataFrame, threshold: DataFrame) -> DataFrame:
    """Consecutive present days at or above the zone's threshold, up to each day.

    ``daily``: (zone, local_date, temp_mean); ``threshold``: (zone, threshold). One row per
    calendar day, so the zone window is small by construction.
    """
    hot = F.coalesce((F.col("temp_mean") >= F.col("threshold")).cast("int"), F.lit(0))
    w = W.partitionBy("zone").orderBy("local_date").rowsBetween(W.unboundedPreceding, 0)
    runs = W.partitionBy("zone", "_run").orderBy("local_date").rowsBetween(W.unboundedPreceding, 0)
    return (daily.join(threshold, "zone").withColumn("_hot", hot)
            .withColumn("_run", F.sum(1 - F.col("_hot")).over(w))
            .withColumn("streak", F.sum("_hot").over(runs))
            .drop("_hot", "_run", "threshold"))


def group_departure(df: DataFrame, col: str, keys: list[str], out: str = "departure") -> DataFrame:
    """Value minus the mean of its group; combined before the shuffle and joined back."""
    means = df.groupBy(*keys).agg(F.avg(col).alias("_mean"))
    return df.join(means, keys).withColumn(out, F.col(col) - F.col("_mean")).drop("_mean")


