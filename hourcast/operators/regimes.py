"""Season and expert of every (month, hour): a fixed dimension of 12 x 24 rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import EXPERT_HOURS, SEASON_MONTHS


def check_regimes(seasons: dict = SEASON_MONTHS, experts: dict = EXPERT_HOURS) -> None:
    """Months and, per season, hours must tile 1..12 and 0..23 without overlap."""
    months = sorted(m for ms in seasons.values() for m in ms)
    if months != list(range(1, 13)):
        raise ValueError("season months must tile 1..12")
    for season in seasons:
        hours = sorted(h for hs in experts[season].values() for h in hs)
        if hours != list(range(24)):
            raise ValueError(f"expert hours of {season} must tile 0..23")


def regime_map(spark: SparkSession, seasons: dict = SEASON_MONTHS,
               experts: dict = EXPERT_HOURS) -> DataFrame:
    """(month, hour, season, expert): always 288 rows."""
    check_regimes(seasons, experts)
    rows = [(m, h, s, e) for s, ms in seasons.items() for m in ms
            for e, hs in experts[s].items() for h in hs]
    return spark.createDataFrame(rows, "month int, hour int, season string, expert string")


def season_of(month: Column, seasons: dict = SEASON_MONTHS) -> Column:
    """Season name of a month as an expression."""
    out = F.lit(None).cast("string")
    for season, months in seasons.items():
        out = F.when(month.isin(*months), season).otherwise(out)
    return out


def add_regime(df: DataFrame, local: str = "ts_local", day: str | None = None,
               hour: str = "hour", seasons: dict = SEASON_MONTHS, experts: dict = EXPERT_HOURS) -> DataFrame:
    """Tag rows with (season, expert), by wall clock or by (target day, hour slot)."""
    table = regime_map(df.sparkSession, seasons, experts)
    month = F.month(day) if day else F.month(local)
    slot = F.col(hour) if day else F.hour(local)
    keyed = df.withColumns({"_m": month, "_h": slot})
    dim = table.select(F.col("month").alias("_m"), F.col("hour").alias("_h"), "season", "expert")
    # 288 rows whatever the data: safe to broadcast.
    return keyed.join(F.broadcast(dim), ["_m", "_h"]).drop("_m", "_h")


def regime_slice(df: DataFrame, season: str, expert: str | None = None, **kw) -> DataFrame:
    """Rows of one season, or of one of its experts."""
    out = add_regime(df, **kw).where(F.col("season") == season)
    return out if expert is None else out.where(F.col("expert") == expert)
