"""Cleaning: flags, outliers, interpolation, gaps. Rows are flagged rather than dropped."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cyclic, is_us_holiday, truthy
from .chunks import hour_number, neighbours, salted_join, zone_totals
from .quantiles import quantiles


def drop_unverified_tail(df: DataFrame, flag: str = "is_verified") -> DataFrame:
    """Drop rows after a zone's last verified hour; interior unverified rows stay.

    Without the flag column, or in a zone with no verified hour, nothing is dropped.
    """
    if flag not in df.columns:
        return df
    last = F.max(F.when(truthy(F.col(flag)), F.col("ts_utc")))
    kept = F.col("_last_verified").isNull() | (F.col("ts_utc") <= F.col("_last_verified"))
    return zone_totals(df, {"_last_verified": (last, F.max)}).where(kept).drop("_last_verified")


def null_upper_outliers(df: DataFrame, col: str, k: float = 10.0) -> DataFrame:
    """Set values above q3 + k * IQR of their zone to null (upper side only)."""
    q = quantiles(df, ["zone"], col, [0.25, 0.75], "_q")
    limit = F.col("_q")[1] + k * (F.col("_q")[1] - F.col("_q")[0])
    return (salted_join(df, q, ["zone"], ["ts_utc"], "left")
            .withColumn(col, F.when(F.col(col) > limit, None).otherwise(F.col(col))).drop("_q"))


def _line(col: str, inside_only: bool, max_gap: int | None = None) -> Column:
    """Value on the straight line between the known neighbours of a ``neighbours`` row."""
    prev, nxt, pos = F.col(f"_prev_{col}"), F.col(f"_next_{col}"), F.col("_pos")
    step = F.try_divide((pos - prev["pos"]).cast("double"), nxt["pos"] - prev["pos"])
    filled = F.when(prev.isNotNull() & nxt.isNotNull(), prev["v"] + (nxt["v"] - prev["v"]) * step)
    if not inside_only:
        filled = F.coalesce(filled, prev["v"], nxt["v"])
    if max_gap is not None:
        filled = F.when(nxt["pos"] - prev["pos"] - 1 <= max_gap, filled)
    return F.coalesce(F.col(col), filled)


def interpolate(df: DataFrame, col: str, inside_only: bool = False,
                max_gap: int | None = None, position: str = "rank") -> DataFrame:
    """Fill nulls on the straight line between the nearest known rows, by row position.

    Leading and trailing nulls take the nearest known value, or stay null with ``inside_only``.
    ``max_gap`` leaves longer runs of nulls alone.
    """
    near = neighbours(df, [col], position)
    return (near.withColumn(col, _line(col, inside_only, max_gap))
            .drop("_pos", f"_prev_{col}", f"_next_{col}"))


def fill_forward_back(df: DataFrame, cols: Sequence[str], max_gap: int | None = None) -> DataFrame:
    """Nulls take the last known value before them, else the first one after; with ``max_gap`` only
    when that value is at most so many hours away."""
    out = neighbours(df, cols, "clock")
    filled = {}
    for c in cols:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        value = F.coalesce(prev["v"], nxt["v"])
        if max_gap is not None:
            gap = F.coalesce(F.col("_pos") - prev["pos"], nxt["pos"] - F.col("_pos"))
            value = F.when(gap <= max_gap, value)
        filled[c] = F.coalesce(F.col(c), value)
    return out.withColumns(filled).drop("_pos", *[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])


def rescale(df: DataFrame, col: str, divisors: Mapping[str, float]) -> DataFrame:
    """Divide a regional aggregate down to zone scale; zones not listed keep their values."""
    if not divisors:
        return df
    entries = [F.lit(v) for pair in sorted(divisors.items()) for v in pair]
    table = F.create_map(*entries)
    return df.withColumn(col, F.col(col) / F.coalesce(table[F.col("zone")], F.lit(1.0)))


def rescale_by_table(df: DataFrame, col: str, divisors: DataFrame) -> DataFrame:
    """As ``rescale``, with a (zone, divisor) table for many zones."""
    table = divisors.select("zone", F.col("divisor").alias("_d"))
    return (salted_join(df, table, ["zone"], ["ts_utc"], "left")
            .withColumn(col, F.col(col) / F.coalesce(F.col("_d"), F.lit(1.0))).drop("_d"))


def flag_labels(df: DataFrame, label: str = "load") -> DataFrame:
    """``has_label``: the label was present before any cleaning."""
    return df.withColumn("has_label", F.col(label).isNotNull().cast("int"))


def repair_impossible(df: DataFrame, col: str = "load", position: str = "rank") -> DataFrame:
    """Values <= 0 become null and interior nulls are interpolated, but only in a zone that holds
    such a value; the unlabelled tail is never filled."""
    out = _repaired(df, col, position, {})
    return out.drop("_bad")


def _repaired(df: DataFrame, col: str, position: str, totals: dict) -> DataFrame:
    bad = F.max(F.coalesce(F.col(col) <= 0, F.lit(False)))
    near = neighbours(df.withColumn("_fixed", F.when(F.col(col) > 0, F.col(col))), ["_fixed"], position,
                      totals={"_bad": (bad, F.max), **totals})
    value = F.when(F.col("_bad"), _line("_fixed", inside_only=True)).otherwise(F.col(col))
    return near.withColumn(col, value).drop("_fixed", "_pos", "_prev__fixed", "_next__fixed")


def add_calendar(df: DataFrame, local: str = "ts_local") -> DataFrame:
    """hour, month, cyclic pairs, dayofweek (Monday 0), is_weekend, is_holiday.

    A holiday that falls on the first local day of a zone counts only if the series starts at
    midnight of it.
    """
    out = zone_totals(df, {"_first_local": (F.min(local), F.min)})
    return out.withColumns(_calendar(local)).drop("_first_local")


def _calendar(local: str) -> dict[str, Column]:
    c = F.col(local)
    hour_sin, hour_cos = cyclic(F.hour(c), 24)
    month_sin, month_cos = cyclic(F.month(c), 12)
    day = F.to_date(c)
    holiday = is_us_holiday(day) & (day.cast("timestamp_ntz") >= F.col("_first_local"))
    return {
        "hour": F.hour(c), "month": F.month(c), "hour_sin": hour_sin, "hour_cos": hour_cos,
        "month_sin": month_sin, "month_cos": month_cos, "dayofweek": F.weekday(c),
        "is_weekend": (F.weekday(c) >= 5).cast("int"), "is_holiday": holiday.cast("int"),
    }


def flag_validity(df: DataFrame, col: str = "load", limit: float = 3.0,
                  fit_on: Column | None = None) -> DataFrame:
    """``is_valid``: labelled and within ``limit`` sample deviations of the (month, hour) mean.

    The mean is taken over all rows of the zone; ``fit_on`` restricts it, e.g. to train rows. A group
    is at most 31 rows a year, so a window is one shuffle and reads its input once.
    """
    group = W.partitionBy("zone", "month", "hour")
    x = F.col(col) if fit_on is None else F.when(fit_on, F.col(col))
    z = F.abs((F.col(col) - F.avg(x).over(group)) / (F.stddev_samp(x).over(group) + 1e-6))
    ok = F.coalesce(z <= limit, F.lit(False)) & (F.col("has_label") == 1)
    return df.withColumn("is_valid", ok.cast("int"))


def gaps(df: DataFrame, step_hours: float = 1.0, tolerance: float = 0.0) -> DataFrame:
    """Rows whose distance to the row before is not ``step_hours``: (zone, ts_utc, step_hours).

    With a tolerance only longer steps count, as in the 1.5 h rule of the join check.
    """
    keyed = df.select("zone", "ts_utc").withColumn("cell", F.floor(hour_number(F.col("ts_utc")) / 2160))
    inner = W.partitionBy("zone", "cell").orderBy("ts_utc")
    across = W.partitionBy("zone").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    heads = (keyed.groupBy("zone", "cell").agg(F.max("ts_utc").alias("_end"))
             .select("zone", "cell", F.last("_end").over(across).alias("_prior")))
    prev = F.coalesce(F.lag("ts_utc").over(inner), F.col("_prior"))
    hours = (F.unix_seconds("ts_utc") - F.unix_seconds(prev)) / 3600.0
    stepped = keyed.join(heads, ["zone", "cell"]).withColumn("step_hours", hours)
    wrong = (F.col("step_hours") > step_hours + tolerance if tolerance
             else F.col("step_hours") != step_hours)
    return stepped.where(wrong).select("zone", "ts_utc", "step_hours")


def contiguity_report(df: DataFrame) -> DataFrame:
    """Per zone: number of wrong steps and the first one; empty when every zone is contiguous."""
    return (gaps(df).groupBy("zone")
            .agg(F.count(F.lit(1)).alias("n_gaps"), F.min("ts_utc").alias("first_gap")))


def gate_contiguous(df: DataFrame) -> DataFrame:
    """Raise if any zone has a hole. This is the one action of the ingest plan."""
    first = contiguity_report(df).orderBy("first_gap").limit(1).collect()
    if first:
        row = first[0]
        raise ValueError(f"zone {row['zone']} is not contiguous: {row['n_gaps']} wrong step(s), "
                         f"first at {row['first_gap']}")
    return df


def alignment_report(df: DataFrame) -> DataFrame:
    """Per zone: rows, distinct hours, duplicate rows and steps above 1.5 h."""
    hours = df.groupBy("zone", "ts_utc").agg(F.count(F.lit(1)).alias("_k"))
    sizes = hours.groupBy("zone").agg(
        F.sum("_k").alias("n_rows"), F.count(F.lit(1)).alias("n_hours"),
        F.sum(F.col("_k") - 1).alias("n_duplicates"))
    long_steps = gaps(hours, 1.0, 0.5).groupBy("zone").agg(F.count(F.lit(1)).alias("n_gaps"))
    return (sizes.join(long_steps, "zone", "left")
            .withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0))))


def training_view(df: DataFrame) -> DataFrame:
    """Labelled rows only, without the flag."""
    return df.where(F.col("has_label") == 1).drop("has_label")


def complete_days(df: DataFrame, tz: str | None = None) -> DataFrame:
    """Local days that reach hour 23; with ``tz`` they must also hold all 23/24/25 hours."""
    from ..functions import day_hours
    days = (df.withColumn("local_date", F.to_date("ts_local")).groupBy("zone", "local_date")
            .agg(F.max("ts_local").alias("_last"), F.count(F.lit(1)).alias("n_hours")))
    ok = F.hour("_last") == 23
    if tz is not None:
        ok = ok & (F.col("n_hours") == day_hours(F.col("local_date"), tz))
    return days.where(ok).drop("_last")


def split_hours(df: DataFrame, days: DataFrame, valid_only: bool = True) -> DataFrame:
    """Hourly rows whose local day is in ``days`` (zone, target_day); valid rows only by default."""
    rows = df.where(F.col("is_valid") == 1) if valid_only else df
    keys = days.select("zone", F.col("target_day").alias("local_date"))
    return (rows.withColumn("local_date", F.to_date("ts_local"))
            .join(keys, ["zone", "local_date"], "left_semi"))


def clean(df: DataFrame, position: str = "rank", fit_on: Column | None = None) -> DataFrame:
    """The whole cleaning step: label flag, impossible loads, calendar, validity.

    Repair and calendar share one summary per (zone, block), so the input is read twice in all.
    """
    out = _repaired(flag_labels(df.drop("POP_pct")), "load", position,
                    {"_first_local": (F.min("ts_local"), F.min)})
    return flag_validity(out.withColumns(_calendar("ts_local")).drop("_bad", "_first_local"), fit_on=fit_on)


