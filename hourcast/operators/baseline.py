"""Naive same-hour baseline and the residual target built on it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .samples import _per_sample, lookback_join

MODES = ("hourly", "scalar")


def baseline_aggs(lookback: int, mode: str = "hourly", positional: bool = False,
                  col: str = "load_est") -> Column:
    """24 values from the lookback rows: mean per clock hour, or the window mean for every hour.

    ``positional=True`` counts slots from the window start instead of reading the clock, which is
    the same thing except around a clock change or with a cutoff other than midnight.
    """
    if mode not in MODES:
        raise ValueError(f"baseline mode must be one of {MODES}, got {mode!r}")
    x = F.col(col)
    if mode == "scalar":
        mean = F.when(F.count(F.when(x.isNull(), 1)) == 0, F.avg(x))
        return F.array_repeat(mean, 24)
    slot = f"pmod({lookback} - off, 24)" if positional else "hour(ts_local)"
    means = [f"CASE WHEN count_if({slot} = {h} AND {col} IS NULL) = 0 THEN avg(CASE WHEN {slot} = {h} THEN {col} END) END"
             for h in range(24)]
    return F.expr(f"array({', '.join(means)})")


def baseline(df: DataFrame, index: DataFrame, lookback: int = 168, mode: str = "hourly",
             positional: bool = False, position: str = "rank") -> DataFrame:
    """(zone, target_day, base): same-hour mean of the preliminary load over the lookback."""
    joined = lookback_join(df, index, lookback, position)
    return _per_sample(joined, {"base": baseline_aggs(lookback, mode, positional)})


def baseline_from_samples(samples: DataFrame, channel: int = 0, mode: str = "hourly") -> DataFrame:
    """Positional baseline read off a sample's own ``seq`` (raw units, ``channel`` = load_est)."""
    x = F.transform("seq", lambda r: r[channel])
    if mode == "scalar":
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        return samples.withColumn("base", F.array_repeat(total / F.size(x), 24))
    hours = F.sequence(F.lit(0), F.lit(23))

    def slot_mean(h: Column) -> Column:
        vals = F.filter(x, lambda v, i: F.pmod(i, F.lit(24)) == h)
        return F.try_divide(F.aggregate(vals, F.lit(0.0), lambda a, v: a + v), F.size(vals))

    return samples.withColumn("base", F.transform(hours, slot_mean))


def residual_target(samples: DataFrame) -> DataFrame:
    """``residual`` = y - base, slot by slot."""
    return samples.withColumn("residual", F.zip_with("y", "base", lambda y, b: y - b))


def add_back(pred: DataFrame, residual: str = "residual_hat", out: str = "yhat") -> DataFrame:
    """Predicted residual + base."""
    return pred.withColumn(out, F.zip_with(residual, "base", lambda r, b: r + b))


def fit_residual_scaler(fit_samples: DataFrame) -> DataFrame:
    """(zone, feature='residual', mean, scale) over exactly the samples the model is fitted on."""
    from .scaling import fit_scaler
    rows = fit_samples.select("zone", F.explode("residual").alias("residual"))
    return fit_scaler(rows, ["residual"])


