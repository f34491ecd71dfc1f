"""The daily roll: recent window -> targets -> predictions per real hour -> store."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.align import expand_to_real_hours, extend_future
from ..operators.quality import complete_days
from ..operators.samples import ThermalRefs, serving_samples
from ..operators.store import freeze_merge, prune
from ..schema import SampleConfig
from ..sources.tables import stage
from ..sources.versions import DAY, Version, VersionedTable


def daily_targets(df: DataFrame, window: int = 8, horizon: int = 2, tz: str | None = None) -> DataFrame:
    """(zone, target_day): the last ``window`` complete days and the ``horizon`` days after them. With ``tz``
    a complete day holds all its 23, 24 or 25 hours."""
    days = complete_days(df, tz).select("zone", F.col("local_date").alias("target_day"))
    w = W.partitionBy("zone").orderBy(F.desc("target_day"))
    past = days.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= window).drop("_r")
    last = days.groupBy("zone").agg(F.max("target_day").alias("_last"))
    ahead = last.select("zone", F.explode(F.sequence(
        F.date_add("_last", 1), F.date_add("_last", horizon))).alias("target_day"))
    return past.unionByName(ahead)


def apply_models(samples: DataFrame, models: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Long (zone, target_day, model, yhat): each model maps usable samples to 24 values."""
    usable = samples.where(F.col("status") == "ok")
    parts = [fn(usable).select("zone", "target_day", F.lit(name).alias("model"), "yhat")
             for name, fn in models.items()]
    out = samples.sparkSession.createDataFrame([], "zone string, target_day date, model string, yhat array<double>")
    for p in parts:
        out = out.unionByName(p)
    return out


def fresh_rows(frame: DataFrame, metered: DataFrame, fc: DataFrame | None, refs: ThermalRefs,
               models: Mapping[str, Callable[[DataFrame], DataFrame]], cfg: SampleConfig = SampleConfig(position="rank"),
               window: int = 8, horizon: int = 2) -> DataFrame:
    """What one run for all zones adds: a row for each real hour of its target days, with a column for each
    model and the metered load where it is known. A target that cannot be built is simply absent; its reason is
    in ``serving_samples``."""
    extended = stage(extend_future(frame, horizon, cfg.tz), "extended")  # read for index, windows, days and targets
    targets = daily_targets(frame, window, horizon, cfg.tz)
    samples = serving_samples(extended, targets, fc, refs, cfg)
    hours = expand_to_real_hours(apply_models(samples, models), cfg.tz)
    wide = hours.groupBy("zone", "ts_utc").agg(
        F.first("ts_local").alias("ts_local"),
        *[F.round(F.max(F.when(F.col("model") == m, F.col("yhat"))), 1).alias(f"{m}_pred") for m in models])
    known = metered.select("zone", "ts_utc", F.col("load").alias("metered")).hint("merge")  # hours of all zones
    return wide.join(known, ["zone", "ts_utc"], "left")


def roll(frame: DataFrame, metered: DataFrame, fc: DataFrame | None, refs: ThermalRefs,
         models: Mapping[str, Callable[[DataFrame], DataFrame]], store: DataFrame | None = None,
         cfg: SampleConfig = SampleConfig(position="rank"), window: int = 8, horizon: int = 2,
         keep_days: int | None = 10) -> DataFrame:
    """``fresh_rows`` merged into a wide store, which is returned and not written."""
    fresh = stage(fresh_rows(frame, metered, fc, refs, models, cfg, window, horizon), "fresh")
    empty = fresh.limit(0) if store is None else store
    return freeze_merge(empty, fresh, keep_days)


def merge_into(store: VersionedTable, fresh: DataFrame, keep_days: int | None = 10) -> Version:
    """Merge fresh rows into the written store: only the days they touch are read and written, as one new version;
    days that no zone keeps any longer are dropped from it. Read the store by ``read_store``."""
    fresh = stage(fresh, "fresh")
    days = [r[DAY].isoformat() for r in fresh.select(F.to_date("ts_utc").alias(DAY)).distinct().collect()]
    version = store.version()
    old = fresh.limit(0) if version.schema is None else store.read(version, days).drop(DAY)
    merged = freeze_merge(old, fresh, None).withColumn(DAY, F.to_date("ts_utc"))
    new = store.commit(merged, keep_days=keep_days)
    if keep_days is None:
        return new
    # A zone's limit follows its own latest hour, so a day goes when the zone furthest behind has left it.
    last = store.read(new).groupBy("zone").agg(F.max("ts_utc").alias("last_ts"))
    oldest = last.agg(F.to_date(F.min("last_ts") - F.make_dt_interval(days=F.lit(keep_days)))).first()[0]
    gone = [d for d in new.days if oldest is not None and d < oldest.isoformat()]
    return store.commit(None, gone) if gone else new


def read_store(store: VersionedTable, version: Version | None = None) -> DataFrame:
    """The wide store of a version, each zone cut to the days it keeps."""
    version = version or store.version()
    return prune(store.read(version).drop(DAY), version.settings.get("keep_days"))
