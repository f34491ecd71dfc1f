"""One sample per (zone, target day): lookback window, statics and 24-hour target.

Hourly rows are shuffled once, by (zone, chunk) with a halo of ``history`` rows, and each (zone, chunk) becomes one
array of them. A sample cuts its window out of that array, so no row is copied for each sample that sees it. The
windows themselves are cut last, after all joins, and only if they are asked for.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cyclic
from ..schema import LEAD_DAYS, SampleConfig
from .chunks import CHUNK_HOURS, chunk_window, with_halo, with_position, zone_totals
from .quantiles import quantiles
from .rolling import THERMAL_REACH, daily_temperature, heat_streak, thermal_columns

SAMPLE_KEYS = ["zone", "target_day"]
NIGHT_HOURS = (1, 6)
RECENT_HOURS = 6
PEAK_HOURS = (14, 19)
ISSUE_OFFSET_DAYS = 2


# ---- index ---------------------------------------------------------------------------------

def sample_index(df: DataFrame, cfg: SampleConfig = SampleConfig()) -> DataFrame:
    """(zone, target_day, cutoff_pos, zone_start, status) for every present day after the first.

    The cutoff is the first row at ``cutoff_hour`` of the present day before the target (two
    present days before when the hour is above 9). Status: ok, no_cutoff, short.
    """
    rows = with_position(df, cfg.position)
    at_cutoff = F.when(F.hour("ts_local") == cfg.cutoff_hour, F.col("pos"))
    days = rows.groupBy("zone", F.to_date("ts_local").alias("target_day")).agg(
        F.min("pos").alias("_first"), F.min(at_cutoff).alias("_at"))
    w = W.partitionBy("zone").orderBy("target_day")
    back = 1 if cfg.cutoff_hour <= 9 else 2
    need = max(cfg.lookback, cfg.history)
    out = days.select(
        *SAMPLE_KEYS, F.lag("_at", back).over(w).alias("cutoff_pos"),
        F.min("_first").over(W.partitionBy("zone")).alias("zone_start"),
        F.lag("target_day").over(w).alias("_today"))
    status = (F.when(F.col("cutoff_pos").isNull(), "no_cutoff")
              .when(F.col("cutoff_pos") - F.col("zone_start") < need, "short").otherwise("ok"))
    return out.where(F.col("_today").isNotNull()).drop("_today").withColumn("status", status)


def lookback_join(df: DataFrame, index: DataFrame, hours: int, position: str = "rank",
                  windows: dict[str, Column] | None = None, reach: int = 0,
                  size: int | None = None) -> DataFrame:
    """Rows in [cutoff - hours, cutoff) of each sample, with ``off`` = rows before the cutoff.

    An equi-join on (zone, chunk): each row is copied only into the next chunk when a cutoff there
    can see it. ``windows`` are evaluated once per row inside the chunk, ``reach`` rows back. A chunk is twice as long as
    a row is seen unless given: half of the rows are copied, and a row meets few samples that do not see it.
    """
    size = size or 2 * (hours + reach)
    rows = with_halo(with_position(df, position), hours + reach, size)
    if windows:
        rows = rows.withColumns(windows)
    keys = index.select(*SAMPLE_KEYS, "cutoff_pos", F.floor(F.col("cutoff_pos") / size).alias("chunk"))
    off = F.col("cutoff_pos") - F.col("pos")
    return (rows.join(keys, ["zone", "chunk"])
            .where((F.col("pos") < F.col("cutoff_pos"))
                   & (F.col("pos") >= F.col("cutoff_pos") - hours))
            .withColumn("off", off))


def _per_sample(joined: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    return (joined.groupBy("zone", "chunk", "target_day")
            .agg(*[c.alias(n) for n, c in aggs.items()]).drop("chunk"))


def window_rows(df: DataFrame, index: DataFrame, hours: int, fields: dict[str, Column], position: str = "rank",
                windows: dict[str, Column] | None = None, reach: int = 0, size: int = CHUNK_HOURS,
                how: str = "inner") -> DataFrame:
    """The rows of ``index`` with ``rows``: those in [cutoff - hours, cutoff), oldest first, as structs of ``pos`` and
    ``fields``; and ``from_pos``, the position of the first of them where none is missing or doubled, else null.
    ``windows`` are evaluated once per hour inside the chunk, ``reach`` rows back.

    Samples are hashed by (zone, chunk) and one array per (zone, chunk) runs past them: neither the hours nor the
    samples are sorted or written for it.
    """
    held = with_halo(with_position(df, position), hours + reach, size)
    if windows:
        held = held.withColumns(windows)
    row = F.struct("pos", *[c.alias(n) for n, c in fields.items()])
    held = held.groupBy("zone", "chunk").agg(F.sort_array(F.collect_list(row)).alias("_held"))
    # Seen once a chunk: where no position is missing or doubled, a window is a slice of known place.
    first = F.col("_held")[0]["pos"]
    gaps = F.transform("_held", lambda r, i: r["pos"] - i)
    held = held.select("zone", "chunk", "_held", F.when((F.array_min(gaps) == first) & (F.array_max(gaps) == first), first).alias("_even"))
    keyed = index.withColumn("chunk", F.floor(F.col("cutoff_pos") / size)).hint("shuffle_hash")
    seen = F.filter("_held", lambda r: (r["pos"] < F.col("cutoff_pos")) & (r["pos"] >= F.col("cutoff_pos") - hours))
    start = F.greatest(F.col("cutoff_pos") - hours - F.col("_even"), F.lit(0))
    cut = F.slice("_held", (start + 1).cast("int"), F.greatest(F.col("cutoff_pos") - F.col("_even") - start, F.lit(0)).cast("int"))
    return (keyed.join(held, ["zone", "chunk"], how)
            .withColumn("rows", F.when(F.col("_even").isNotNull(), cut).otherwise(seen))
            .withColumn("from_pos", F.col("_even") + start).drop("chunk", "_held", "_even"))


def _region(lo: int, hi: int, rows: str = "rows") -> Column:
    """The rows that lie ``lo`` to ``hi`` positions before the cutoff: a slice where ``window_rows`` found no position
    missing or doubled, and so knows the place of each."""
    seen = F.filter(rows, lambda r: (F.col("cutoff_pos") - r["pos"]).between(lo, hi))
    start = F.greatest(F.col("cutoff_pos") - hi - F.col("from_pos"), F.lit(0))
    length = F.greatest(F.col("cutoff_pos") - lo + 1 - F.col("from_pos") - start, F.lit(0))
    cut = F.slice(rows, (start + 1).cast("int"), length.cast("int"))
    return F.when(F.col("from_pos").isNotNull(), cut).otherwise(seen)


def _strict(agg: Column, values: Column) -> Column:
    """Null as soon as one value of the region is null, as array arithmetic would have it; null without values."""
    return F.when((F.size(values) > 0) & ~F.exists(values, lambda v: v.isNull()), agg)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _quantile(values: Column, share: float) -> Column:
    """The linearly interpolated quantile of a few values."""
    ordered, at = F.sort_array(values), (F.size(values) - 1) * F.lit(share)
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(ordered, lo), F.get(ordered, hi)
    return F.when(a == b, a).otherwise((hi - at) * a + (at - lo) * b)


# ---- window, flattened window --------------------------------------------------------------

def _sequence_fields(cols: Sequence[str]) -> dict[str, Column]:
    return {"v": F.array(*[F.col(c).cast("double") for c in cols])}


def _sequence() -> Column:
    return F.transform("rows", lambda r: r["v"])


def assemble_windows(df: DataFrame, index: DataFrame, cols: Sequence[str], lookback: int,
                     position: str = "rank") -> DataFrame:
    """``seq``: lookback rows, oldest first, each an array of ``cols``."""
    keys = index.select(*SAMPLE_KEYS, "cutoff_pos")
    seen = window_rows(df, keys, lookback, _sequence_fields(cols), position).where(F.size("rows") > 0)
    return seen.select(*SAMPLE_KEYS, _sequence().alias("seq"))


def flatten_windows(samples: DataFrame, cols: Sequence[str], scalars: dict[str, Column] | None = None,
                    carry: Sequence[str] = ()) -> DataFrame:
    """``seq`` -> one row per flattened column: (keys, name ``<col>_h<k>``, value), k = 0 oldest. ``scalars`` of the sample
    follow as further rows, and the columns ``carry`` ride along, so that neither needs a join."""
    lags = F.flatten(F.transform("seq", lambda row, k: F.array(*[
        F.struct(F.concat(F.lit(f"{c.lower()}_h"), k.cast("string")).alias("name"), row[j].alias("value"))
        for j, c in enumerate(cols)])))
    more = [F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in scalars.items()])] if scalars else []
    return (samples.select(*SAMPLE_KEYS, *carry, F.explode(F.concat(lags, *more)).alias("_e"))
            .select(*SAMPLE_KEYS, *carry, "_e.name", "_e.value"))


def flat_vector(samples: DataFrame) -> DataFrame:
    """``flat``: the window as one array in ``<col>_h<k>`` order (column first, then lag)."""
    n = F.size(F.col("seq")[0])
    return samples.withColumn("flat", F.flatten(F.transform(
        F.sequence(F.lit(0), n - 1), lambda j: F.transform("seq", lambda r: r[j]))))


def channel_mean(j: int) -> Column:
    """Mean of one column of ``seq`` over the window."""
    return F.aggregate("seq", F.lit(0.0), lambda acc, row: acc + row[j]) / F.size("seq")


# ---- target day ----------------------------------------------------------------------------

def normalise_24(rows: Column) -> Column:
    """array<struct(pos, hour, v)> of one local day -> 24 values by clock hour, or null.

    24 rows stay in order; on a 25-row day a repeated hour is averaged; on a 23-row day the
    missing hour is interpolated between its neighbours. Any other length gives null.
    """
    hours = F.sequence(F.lit(0), F.lit(23))

    def at(h: Column) -> Column:
        return F.filter(rows, lambda r: r["hour"] == h)

    def mean_at(h: Column) -> Column:
        total = F.aggregate(at(h), F.lit(0.0), lambda acc, r: acc + r["v"])
        return F.try_divide(total, F.size(at(h)))

    def last_at(h: Column) -> Column:
        return F.get(F.transform(at(h), lambda r: r["v"]), F.size(at(h)) - 1)

    def let(value: Column, body) -> Column:
        """Evaluate ``value`` once and hand it to ``body``."""
        return F.get(F.transform(F.array(value), body), 0)

    def bridged(seen: Column, known: Column, v: Column, i: Column) -> Column:
        left = F.array_max(F.filter(known, lambda j: j < i))
        right = F.array_min(F.filter(known, lambda j: j > i))
        a, b = F.get(seen, left), F.get(seen, right)
        return F.coalesce(v, a + (b - a) * (i - left) / (right - left), a, b)

    def bridge(seen: Column) -> Column:
        known = F.filter(hours, lambda j: F.get(seen, j).isNotNull())
        return let(known, lambda k: F.transform(seen, lambda v, i: bridged(seen, k, v, i)))

    n = F.size(rows)
    return (F.when(n == 24, F.transform(rows, lambda r: r["v"]))
            .when((n == 25) & F.forall(hours, lambda h: F.size(at(h)) > 0), F.transform(hours, mean_at))
            .when(n == 23, let(F.transform(hours, last_at), bridge)))


def _day_rows(value: str) -> Column:
    row = F.struct(F.col("pos"), F.hour("ts_local").alias("hour"),
                   F.col(value).cast("double").alias("v"))
    return F.array_sort(F.collect_list(row))


def day_targets(df: DataFrame, value: str = "load", position: str = "rank") -> DataFrame:
    """``y``: 24 values per local day (null for an unusable day), and ``is_target_valid``."""
    rows = with_position(df, position)
    valid = F.min("is_valid") if "is_valid" in df.columns else F.lit(1)
    days = rows.groupBy("zone", F.to_date("ts_local").alias("target_day")).agg(
        _day_rows(value).alias("_rows"), valid.alias("is_target_valid"),
        F.count(F.lit(1)).alias("n_hours"))
    return days.withColumn("y", normalise_24(F.col("_rows"))).drop("_rows")


def _calendar_of(first: Column) -> Column:
    dow_sin, dow_cos = cyclic(first["dayofweek"], 7)
    return F.array(first["month_sin"], first["month_cos"], dow_sin, dow_cos,
                   first["is_weekend"].cast("double"), first["is_holiday"].cast("double"))


_CALENDAR_FIELDS = ["month_sin", "month_cos", "dayofweek", "is_weekend", "is_holiday"]


def target_calendar(df: DataFrame, position: str = "rank") -> DataFrame:
    """``calendar``: six values of the target day, read off its first row."""
    first = F.min_by(F.struct(*_CALENDAR_FIELDS), "pos")
    days = (with_position(df, position)
            .groupBy("zone", F.to_date("ts_local").alias("target_day")).agg(first.alias("_c")))
    return days.select(*SAMPLE_KEYS, _calendar_of(F.col("_c")).alias("calendar"))


# ---- macro block ---------------------------------------------------------------------------

def _macro_windows(week: int) -> dict[str, Column]:
    return {"_week_ago": F.lag("load_est", week).over(chunk_window())}


def _macro_fields() -> dict[str, Column]:
    return {"hour": F.hour("ts_local"), "x": F.col("load_est").cast("double"), "ago": F.col("_week_ago").cast("double")}


def _macro_regions(week: int) -> dict[str, Column]:
    return {f"_wk{k}": _region((k - 1) * week + 1, k * week) for k in (1, 2, 3)} | {"_recent": _region(1, RECENT_HOURS)}


def _macro_aggs() -> dict[str, Column]:
    out = {}
    for k in (1, 2, 3):
        night = F.filter(f"_wk{k}", lambda r: r["hour"].between(*NIGHT_HOURS))["x"]
        out[f"_q{k}"] = F.when(F.size(night) == 0, 0.0).otherwise(_strict(_quantile(night, 0.05), night))
    for k in (1, 2):
        x = F.col(f"_wk{k}")["x"]
        out[f"_e{k}"] = _strict(_sum(x), x)
    diff = F.transform("_recent", lambda r: F.abs(r["x"] - r["ago"]))
    out["_lag_err"] = _strict(_sum(diff) / F.size(diff), diff)
    return out


def _macro_array() -> Column:
    ratio = F.when(F.col("_e2") == 0, 1.0).otherwise(F.try_divide(F.col("_e1"), F.col("_e2")))
    return F.array(F.col("_q1") - F.col("_q2"), F.col("_q2") - F.col("_q3"), ratio, F.col("_lag_err"))


def macro_features(df: DataFrame, index: DataFrame, week: int = 168,
                   position: str = "rank") -> DataFrame:
    """``macro``: four multi-week features, from the preliminary load only."""
    cols = df.select("zone", "ts_utc", "ts_local", "load_est", *(["pos"] if "pos" in df.columns else []))
    seen = window_rows(cols, index.select(*SAMPLE_KEYS, "cutoff_pos"), 3 * week, _macro_fields(), position, _macro_windows(week))
    feats = seen.where(F.size("rows") > 0).withColumns(_macro_regions(week)).withColumns(_macro_aggs())
    return feats.select(*SAMPLE_KEYS, _macro_array().alias("macro"))


# ---- thermal references and statics --------------------------------------------------------

@dataclass(frozen=True)
class ThermalRefs:
    """Train-fitted references: (zone, threshold) and (zone, doy, clim)."""

    threshold: DataFrame
    climatology: DataFrame


def mark_train(df: DataFrame, test_frac: float, position: str = "rank") -> DataFrame:
    """Add ``is_train``: the first int(n * (1 - test_frac)) rows of each zone, by position."""
    rows = zone_totals(with_position(df, position), {
        "_from": (F.min("pos"), F.min), "_rows": (F.count(F.lit(1)), F.sum)})
    cut = F.col("_from") + F.floor(F.col("_rows") * (1 - test_frac))
    return rows.withColumn("is_train", F.col("pos") < cut).drop("_from", "_rows")


def fit_heat_threshold(daily: DataFrame, pct: float = 0.75, default: float = 75.0) -> DataFrame:
    """(zone, threshold): quantile of the train days' June-August mean temperature.

    ``daily``: (zone, local_date, temp_mean, is_train). A zone without such a day takes ``default``.
    """
    summer = daily.where(F.col("is_train") & F.month("local_date").isin(6, 7, 8))
    q = quantiles(summer, ["zone"], "temp_mean", [pct], "_q")
    zones = daily.select("zone").distinct()
    return zones.join(q, "zone", "left").select(
        "zone", F.coalesce(F.get("_q", 0), F.lit(default)).alias("threshold"))


def fit_climatology(df: DataFrame, half_window: int = 7, temp: str = "Temp_F") -> DataFrame:
    """(zone, doy 1..366, clim): train mean within +- ``half_window`` days of the year, circular.

    Hours are reduced to one (sum, count) per day of year first; a day of year nobody saw takes
    the zone's train mean.
    """
    sums = (df.where(F.col("is_train") & F.col(temp).isNotNull())
            .groupBy("zone", F.dayofyear("ts_local").alias("_d"))
            .agg(F.sum(temp).alias("_s"), F.count(F.lit(1)).alias("_n")))
    reach = F.explode(F.sequence(F.lit(-half_window), F.lit(half_window)))
    spread = (sums.withColumn("_k", reach)
              .groupBy("zone", (F.pmod(F.col("_d") - 1 + F.col("_k"), F.lit(366)) + 1).alias("doy"))
              .agg((F.sum("_s") / F.sum("_n")).alias("_c")))
    overall = sums.groupBy("zone").agg((F.sum("_s") / F.sum("_n")).alias("_all"))
    # The 366 days of a zone are unfolded last: only days near a seen one are ever shuffled.
    near = spread.groupBy("zone").agg(F.map_from_entries(F.collect_list(F.struct("doy", "_c"))).alias("_near"))
    grid = overall.join(near, "zone", "left").withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(366))))
    return grid.select("zone", "doy", F.coalesce(F.try_element_at("_near", "doy"), "_all").alias("clim"))


def fit_thermal_refs(df: DataFrame, test_frac: float = 0.16, half_window: int = 7,
                     position: str = "rank") -> ThermalRefs:
    """Heat threshold and climatology of the train rows."""
    marked = mark_train(df, test_frac, position)
    daily = daily_temperature(marked, train=F.col("is_train"))
    return ThermalRefs(fit_heat_threshold(daily), fit_climatology(marked, half_window))


def stage_refs(refs: ThermalRefs) -> ThermalRefs:
    """References written once, for those who assemble more than one frame with them."""
    from ..sources.tables import stage
    return ThermalRefs(stage(refs.threshold, "threshold"), stage(refs.climatology, "climatology"))


def _thermal_fields() -> dict[str, Column]:
    return {"date": F.to_date("ts_local"), "t": F.col("Temp_F").cast("double"), "c": F.col("CDD_h").cast("double")}


def _thermal_regions() -> dict[str, Column]:
    return {f"_day{k}": _region(24 * k - 23, 24 * k) for k in (1, 2, 3)}


def _thermal_aggs() -> dict[str, Column]:
    one, two, three = (F.col(f"_day{k}") for k in (1, 2, 3))
    all_t = F.concat(one, two, three)["t"]

    def date_at(off: int) -> Column:
        return F.array_max(F.filter(one, lambda r: F.col("cutoff_pos") - r["pos"] == off)["date"])

    def mean(x: Column) -> Column:
        return _strict(_sum(x) / F.size(x), x)

    return {
        "_max1": _strict(F.array_max(one["t"]), one["t"]), "_cdd1": _strict(_sum(one["c"]), one["c"]),
        "_cdd2": _strict(_sum(two["c"]), two["c"]), "_max3": _strict(F.array_max(all_t), all_t),
        "_ma1": mean(one["t"]), "_ma3": mean(three["t"]),
        "_doy": F.dayofyear(date_at(12)), "_last_day": date_at(1),
    }


def _thermal_array() -> Column:
    return F.array(
        F.col("streak").cast("double"), F.col("_max1"), F.col("_cdd1"), F.col("_max3"),
        F.col("_cdd1") / (F.col("_cdd2") + 1e-3), F.col("_ma1") - F.col("_ma3"),
        F.col("_ma1") - F.try_element_at("_clim", "_doy"))


def _with_refs(feats: DataFrame, df: DataFrame, refs: ThermalRefs) -> DataFrame:
    streak = heat_streak(daily_temperature(df), refs.threshold).select(
        "zone", F.col("local_date").alias("_last_day"), "streak")
    # One row a zone: days of the year exploded from zones look like one row a zone, and would be broadcast all of them.
    clim = refs.climatology.groupBy("zone").agg(F.map_from_entries(F.collect_list(F.struct("doy", "clim"))).alias("_clim"))
    return feats.join(streak, ["zone", "_last_day"], "left").join(clim, "zone", "left")


def thermal_static(df: DataFrame, index: DataFrame, refs: ThermalRefs,
                   position: str = "rank", base: float = 65.0) -> DataFrame:
    """``thermal``: seven temperature features of the days before the cutoff."""
    rows = df.withColumn("CDD_h", thermal_columns(base)[0]["CDD_h"])
    seen = window_rows(rows, index.select(*SAMPLE_KEYS, "cutoff_pos"), 72, _thermal_fields(), position)
    feats = seen.where(F.size("rows") > 0).withColumns(_thermal_regions()).withColumns(_thermal_aggs())
    return _with_refs(feats, df, refs).select(*SAMPLE_KEYS, _thermal_array().alias("thermal"))


# ---- forecast block ------------------------------------------------------------------------

def forecast_arrays(fc: DataFrame) -> DataFrame:
    """(zone, issue_date, d0, d1): the 24 + 24 forecast temperatures of each complete issue date."""
    cells = (fc.where(F.col("is_complete") == 1)
             .groupBy("zone", "issue_date", "lead_day", F.hour("valid_local").alias("_h"))
             .agg(F.avg("Temp_F").alias("_t")))
    ordered = F.array_sort(F.collect_list(F.when(
        F.col("_t").isNotNull(), F.struct("lead_day", "_h", "_t"))))
    table = cells.where(F.col("lead_day").isin(*LEAD_DAYS)).groupBy("zone", "issue_date").agg(
        F.transform(ordered, lambda r: r["_t"]).alias("_v"))
    return table.where(F.size("_v") == 48).select(
        "zone", "issue_date", F.slice("_v", 1, 24).alias("d0"), F.slice("_v", 25, 24).alias("d1"))


def missing_forecast_cells(fc: DataFrame) -> DataFrame:
    """(lead, hour) pairs that no complete issue date of any zone carries; empty when usable."""
    have = fc.where(F.col("is_complete") == 1).select(
        "lead_day", F.hour("valid_local").alias("hour")).distinct()
    spark = fc.sparkSession
    want = spark.range(24 * len(LEAD_DAYS)).select(
        (F.floor(F.col("id") / 24) + LEAD_DAYS[0]).cast("int").alias("lead_day"),
        (F.col("id") % 24).cast("int").alias("hour"))
    return want.join(have, ["lead_day", "hour"], "left_anti")


def _reference_fields() -> dict[str, Column]:
    return {"hour": F.hour("ts_local"), "t": F.col("Temp_F").cast("double")}


def _reference_regions(lookback: int) -> dict[str, Column]:
    return {"_inside": _region(1, lookback), "_day1": _region(1, 24)}


def _reference_aggs(base: float) -> dict[str, Column]:
    t, last = F.col("_inside")["t"], F.col("_day1")["t"]

    def mean(found: Column) -> Column:
        return F.get(F.transform(F.array(found), lambda v: F.when(F.size(v) > 0, _sum(v) / F.size(v))), 0)

    # Without a clock change or a hole the rows of an hour stand 24 apart; else they are looked for.
    hours, n = F.col("_inside")["hour"], F.size("_inside")
    steady = F.forall(F.transform(hours, lambda h, i: F.pmod(h - i - F.get(hours, 0), F.lit(24))), lambda k: k == 0)
    places = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.pmod(h - F.get(hours, 0), F.lit(24)))
    apart = F.transform(places, lambda p: F.when(p < n, mean(F.transform(F.sequence(p, F.greatest(p, n - 1), F.lit(24)), lambda i: F.get(t, i)))))
    sought = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: mean(F.filter("_inside", lambda r: r["hour"] == h)["t"]))
    means = F.when(steady & (n > 0), apart).otherwise(sought)
    by_hour = F.get(F.transform(F.array(_sum(t) / F.size(t)), lambda mean: F.transform(means, lambda v: F.coalesce(v, mean))), 0)
    cdd = _sum(F.transform(t, lambda v: F.greatest(F.lit(0.0), v - base)))
    hdd = _sum(F.transform(t, lambda v: F.greatest(F.lit(0.0), base - v)))
    return {"_ref": _strict(by_hour, t), "_wcdd": _strict(cdd, t), "_whdd": _strict(hdd, t),
            "_prev_max": _strict(F.array_max(last), last)}


def _references(df: DataFrame, index: DataFrame, lookback: int, position: str, base: float) -> DataFrame:
    seen = window_rows(df, index.select(*SAMPLE_KEYS, "cutoff_pos"), lookback, _reference_fields(), position)
    return seen.where(F.size("rows") > 0).withColumns(_reference_regions(lookback)).withColumns(_reference_aggs(base)).select(
        *SAMPLE_KEYS, "_ref", "_wcdd", "_whdd", "_prev_max")


def _total(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))


def _forecast_array(lookback: int, base: float) -> Column:
    d0, d1, ref = F.col("d0"), F.col("d1"), F.col("_ref")
    days = lookback / 24.0

    def cdd(a):
        return _total(a, lambda v: F.greatest(F.lit(0.0), v - base))

    def hdd(a):
        return _total(a, lambda v: F.greatest(F.lit(0.0), base - v))

    def mean(a, n):
        return _total(a, lambda v: v) / n

    lo, hi = PEAK_HOURS
    hot = ((mean(d0, 24) >= F.col("threshold")).cast("double")
           + (mean(d1, 24) >= F.col("threshold")).cast("double"))
    tail = F.array(
        cdd(d1) - F.col("_wcdd") / days, hdd(d1) - F.col("_whdd") / days,
        F.array_max(d0) - F.col("_prev_max"), F.array_max(d1) - F.array_max(d0),
        cdd(d0) + cdd(d1) - 2.0 * F.col("_wcdd") / days, F.array_max(d1),
        mean(F.slice(d1, lo + 1, hi - lo + 1), hi - lo + 1), hot)
    return F.concat(F.zip_with(d1, ref, lambda a, b: a - b), tail)


def _with_forecast(feats: DataFrame, fc: DataFrame) -> DataFrame:
    return feats.withColumn("issue_date", F.date_sub("target_day", ISSUE_OFFSET_DAYS)).join(
        forecast_arrays(fc), ["zone", "issue_date"], "left")


def forecast_reference(df: DataFrame, index: DataFrame, lookback: int = 168,
                       position: str = "rank") -> DataFrame:
    """``ref``: mean window temperature by true local hour (24 values)."""
    feats = _references(df, index, lookback, position, 65.0)
    return feats.select(*SAMPLE_KEYS, F.col("_ref").alias("ref"))


def forecast_features(df: DataFrame, index: DataFrame, fc: DataFrame, threshold: DataFrame,
                      lookback: int = 168, position: str = "rank", base: float = 65.0) -> DataFrame:
    """``fc``: 32 departures of the two forecast days from the window; days without a complete
    forecast are absent (see ``unforecastable``)."""
    feats = _references(df, index, lookback, position, base)
    joined = _with_forecast(feats, fc).where(F.col("d0").isNotNull()).join(threshold, "zone")
    return joined.select(*SAMPLE_KEYS, _forecast_array(lookback, base).alias("fc"))


def unforecastable(index: DataFrame, fc: DataFrame) -> DataFrame:
    """Samples without a complete forecast issued two days before the target."""
    have = forecast_arrays(fc).select(
        "zone", F.date_add("issue_date", ISSUE_OFFSET_DAYS).alias("target_day"))
    return index.join(have, SAMPLE_KEYS, "left_anti")


# ---- whole samples -------------------------------------------------------------------------

def assemble(df: DataFrame, fc: DataFrame | None, cfg: SampleConfig, refs: ThermalRefs,
             targets: DataFrame | None = None) -> DataFrame:
    """Every target day, or those of ``targets``, with a ``status``; only rows with status 'ok' are usable samples.

    Status: ok, no_cutoff, short, nan_lookback, no_forecast, bad_target. ``seq`` is cut out last, beside finished
    statics, so no join or sort ever moves a window; who does not read it does not pay for it.
    """
    rows = with_position(df, cfg.position)
    index = sample_index(rows, cfg)
    if targets is not None:
        index = index.join(targets.select(*SAMPLE_KEYS).distinct(), SAMPLE_KEYS, "left_semi")
    usable = index.where(F.col("status") == "ok").select(*SAMPLE_KEYS, "cutoff_pos")
    row_cols, window_cols = thermal_columns(cfg.base_temp)
    hours = max(cfg.lookback, cfg.history, 3 * cfg.week, 72)
    need = max(cfg.lookback, cfg.history)
    holes = [F.col(c).isNull() for c in cfg.seq_cols]
    fields = _macro_fields() | _thermal_fields() | {"hole": reduce(or_, holes, F.lit(False))}
    regions = _macro_regions(cfg.week) | _thermal_regions() | _reference_regions(cfg.lookback)
    aggs = _macro_aggs() | _thermal_aggs() | {
        "_full": (F.size("_inside") == cfg.lookback) & (F.size(_region(1, need)) == need),
        "_hole": F.exists("_inside", lambda r: r["hole"])}
    if fc is not None:
        aggs |= _reference_aggs(cfg.base_temp)
    thermal = rows.withColumns(row_cols)
    seen = window_rows(thermal, usable, hours, fields, cfg.position, window_cols | _macro_windows(cfg.week),
                       reach=0 if hours >= cfg.lookback + THERMAL_REACH else THERMAL_REACH)
    seen = seen.where(F.size("rows") > 0).withColumns(regions).withColumns(aggs).select(*SAMPLE_KEYS, *aggs)
    feats = _with_refs(seen, rows, refs).join(refs.threshold, "zone", "left")
    block = [_macro_array().alias("macro"), _thermal_array().alias("thermal")]
    if fc is not None:
        feats = _with_forecast(feats, fc)
        block.append(F.when(F.col("d0").isNotNull(),
                            _forecast_array(cfg.lookback, cfg.base_temp)).alias("fc"))
    else:
        block.append(F.array().cast("array<double>").alias("fc"))
    feats = feats.select(*SAMPLE_KEYS, "_full", "_hole", *block)

    first = F.min_by(F.struct(*_CALENDAR_FIELDS), "pos")
    days = rows.groupBy("zone", F.to_date("ts_local").alias("target_day")).agg(
        _day_rows("load").alias("_rows"), F.min("is_valid").alias("is_target_valid"),
        first.alias("_c"))
    days = days.select(*SAMPLE_KEYS, normalise_24(F.col("_rows")).alias("y"), "is_target_valid",
                       _calendar_of(F.col("_c")).alias("calendar"))
    out = index.join(feats, SAMPLE_KEYS, "left").join(days, SAMPLE_KEYS)
    # A hole in the hours leaves fewer rows by the clock: such a window is no window.
    full = F.coalesce("_full", F.lit(False))
    status = (F.when(F.col("status") != "ok", F.col("status"))
              .when(~full | F.col("_hole"), "nan_lookback")
              .when(F.col("fc").isNull(), "no_forecast")
              .when(F.col("y").isNull(), "bad_target").otherwise("ok"))
    out = out.select(*SAMPLE_KEYS, "cutoff_pos", "calendar", "macro", "thermal", "fc", "y", "is_target_valid",
                     status.alias("status"), full.alias("has_window"))
    out = window_rows(thermal, out, cfg.lookback, _sequence_fields(cfg.seq_cols), cfg.position, window_cols,
                      reach=THERMAL_REACH, how="left")
    return out.select(*SAMPLE_KEYS, "cutoff_pos", F.when(F.col("has_window"), _sequence()).alias("seq"), "calendar",
                      "macro", "thermal", "fc", "y", "is_target_valid", "status", "has_window")


def build_samples(df: DataFrame, fc: DataFrame | None = None, cfg: SampleConfig = SampleConfig(),
                  refs: ThermalRefs | None = None) -> DataFrame:
    """Training samples: references fitted on the train rows unless given; unusable days dropped.

    A null inside the lookback does not drop a training sample; a window with missing rows does. A
    forecast archive that lacks a (lead, hour) cell on every date raises.
    """
    if fc is not None:
        gone = missing_forecast_cells(fc).collect()  # 48 at most
        if gone:
            raise ValueError(f"no forecast has the cells {[tuple(r) for r in gone]}")
    refs = refs or fit_thermal_refs(df, cfg.test_frac, position=cfg.position)
    full = assemble(df, fc, cfg, refs)
    usable = (F.col("status") == "ok") | ((F.col("status") == "nan_lookback")
                                          & F.col("has_window") & F.col("y").isNotNull()
                                          & F.col("fc").isNotNull())
    return full.where(usable).drop("has_window")


def serving_samples(df: DataFrame, targets: DataFrame, fc: DataFrame | None, refs: ThermalRefs,
                    cfg: SampleConfig = SampleConfig(position="rank")) -> DataFrame:
    """Samples for ``targets`` (zone, target_day) from a short window with frozen references.

    Positions are ranks by default, since the recent hours have passed no gate against holes. A target that cannot be forecast keeps its row with the reason in ``status``.
    """
    served = assemble(df, fc, cfg, refs, targets).drop("has_window").join(targets, SAMPLE_KEYS, "right")
    status = F.coalesce(F.when(F.col("status") == "bad_target", "ok").otherwise(F.col("status")),
                        F.lit("not_in_window"))
    return served.withColumn("status", status)


def materialize(samples: DataFrame, path: str, version: str, cfg: SampleConfig = SampleConfig()) -> DataFrame:
    """Write samples once and read them back. The folder is named by the input's version and by every
    setting and column the samples depend on, so an old cache is never read for other ones; it counts
    only with the mark that is written after the data."""
    spark = samples.sparkSession
    key = hashlib.sha256(repr((cfg, samples.schema.simpleString())).encode()).hexdigest()[:16]
    target = f"{path}/version={version}/config={key}"
    try:
        spark.read.parquet(f"{target}/complete").first()
    except AnalysisException:
        samples.write.mode("overwrite").parquet(f"{target}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{target}/complete")
    return spark.read.parquet(f"{target}/rows")
