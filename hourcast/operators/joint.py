"""Several zones as one sample: the zone list is given and short, the hours are not."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import cyclic
from ..schema import SampleConfig
from .chunks import with_position
from .samples import _day_rows, assemble_windows, normalise_24, sample_index


def joint_hourly(df: DataFrame, zones: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Hours present in every zone, columns prefixed ``<zone>_``. One aggregation, not n joins."""
    mine = df.where(F.col("zone").isin(*zones))
    cells = [F.first(F.when(F.col("zone") == z, F.col(c)), True).alias(f"{z}_{c}")
             for z in zones for c in cols]
    wide = mine.groupBy("ts_utc").agg(F.count_distinct("zone").alias("_k"), *cells)
    return wide.where(F.col("_k") == len(zones)).drop("_k")


def joint_samples(df: DataFrame, zones: Sequence[str], seq_cols: Sequence[str],
                  lookback: int = 168, cutoff_hour: int = 0) -> DataFrame:
    """(target_day, seq, calendar[4], y[24 * zones], is_target_valid) on the common hours.

    Clock columns come from the first zone; only ``lookback`` rows of history are required, and
    there is no macro, thermal or forecast block. ``df`` holds (scaled) hourly rows.
    """
    first = zones[0]
    temporal = ["hour_sin", "hour_cos", "month_sin", "month_cos", "dayofweek", "is_weekend"]
    cols = list(dict.fromkeys([*seq_cols, "load", "is_valid", "ts_local", *temporal, "is_holiday"]))
    wide = joint_hourly(df, zones, cols).withColumns({
        "zone": F.lit("joint"), "ts_local": F.col(f"{first}_ts_local")})
    # The inner join may leave holes, so positions are ranks.
    rows = with_position(wide, "rank")
    cfg = SampleConfig(lookback=lookback, history=lookback, cutoff_hour=cutoff_hour, position="rank")
    index = sample_index(rows, cfg).where(F.col("status") == "ok")
    seq = [f"{z}_{c}" for z in zones for c in seq_cols] + [f"{first}_{t}" for t in temporal]
    windows = assemble_windows(rows, index, seq, lookback)
    meta = F.min_by(F.struct(*[F.col(f"{first}_{c}").alias(c)
                               for c in ("dayofweek", "is_weekend", "is_holiday")]), "pos")
    days = rows.groupBy("zone", F.to_date("ts_local").alias("target_day")).agg(
        *[_day_rows(f"{z}_load").alias(f"_y{i}") for i, z in enumerate(zones)],
        F.least(*[F.min(f"{z}_is_valid") for z in zones], F.lit(1)).alias("is_target_valid"),
        meta.alias("_c"))
    dow_sin, dow_cos = cyclic(F.col("_c.dayofweek"), 7)
    y = F.concat(*[normalise_24(F.col(f"_y{i}")) for i in range(len(zones))])
    days = days.select("zone", "target_day", y.alias("y"), "is_target_valid", F.array(
        dow_sin, dow_cos, F.col("_c.is_weekend").cast("double"),
        F.col("_c.is_holiday").cast("double")).alias("calendar"))
    return (windows.join(days, ["zone", "target_day"]).where(F.col("y").isNotNull())
            .select("target_day", "seq", "calendar", "y", "is_target_valid"))


def per_zone_predictions(pred: DataFrame, zones: Sequence[str]) -> DataFrame:
    """(target_day, model, y[24n], yhat[24n]) -> one row per zone with its own 24 values."""
    parts = F.array(*[F.struct(F.lit(z).alias("zone"), F.slice("y", 24 * i + 1, 24).alias("y"),
                               F.slice("yhat", 24 * i + 1, 24).alias("yhat"))
                      for i, z in enumerate(zones)])
    return pred.select("target_day", "model", F.explode(parts).alias("_e")).select(
        "_e.zone", "model", "target_day", "_e.y", "_e.yhat")
