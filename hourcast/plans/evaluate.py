"""Score forecasts; the naive baseline end to end."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.baseline import baseline
from ..operators.metrics import error_rows, scoreboard
from ..operators.samples import day_targets, sample_index
from ..schema import SampleConfig


def naive_forecast(df: DataFrame, cfg: SampleConfig = SampleConfig(), mode: str = "hourly",
                   positional: bool = False) -> DataFrame:
    """(zone, model, target_day, y, yhat): same-hour mean of the lookback for every usable day."""
    index = sample_index(df, cfg).where(F.col("status") == "ok")
    base = baseline(df, index, cfg.lookback, mode, positional, cfg.position)
    days = day_targets(df, "load", cfg.position).where(F.col("y").isNotNull())
    return base.join(days, ["zone", "target_day"]).select(
        "zone", F.lit("baseline").alias("model"), "target_day", "y", F.col("base").alias("yhat"))


def naive_errors(df: DataFrame, cfg: SampleConfig = SampleConfig(), **kw) -> DataFrame:
    """Hourly error table of the naive forecast."""
    return error_rows(naive_forecast(df, cfg, **kw))


def naive_scoreboard(df: DataFrame, cfg: SampleConfig = SampleConfig(), **kw) -> DataFrame:
    """How good is the naive same-hour-last-week forecast, per zone?"""
    return scoreboard(naive_errors(df, cfg, **kw))
