"""The forecast store: predictions freeze when first written, actuals are upgraded."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .chunks import zone_totals

KEYS = ["zone", "ts_utc"]


def prune(df: DataFrame, keep_days: int | None) -> DataFrame:
    """Hours after a zone's latest one minus ``keep_days``."""
    if keep_days is None:
        return df
    keep = F.col("ts_utc") > F.col("_max") - F.make_dt_interval(days=F.lit(keep_days))
    return zone_totals(df, {"_max": (F.max("ts_utc"), F.max)}).where(keep).drop("_max")


def freeze_merge(store: DataFrame, fresh: DataFrame, keep_days: int | None = 10) -> DataFrame:
    """Wide store (zone, ts_utc, ts_local, metered, <model>_pred...) merged with fresh rows.

    The wall clock and ``metered`` take the newest known value, a ``_pred`` column keeps the one
    written first; columns of models new to the store are added.
    """
    cols = list(dict.fromkeys([c for c in store.columns + fresh.columns if c not in KEYS]))
    old = store.select(*KEYS, *[F.col(c).alias(f"_old_{c}") for c in cols if c in store.columns])
    new = fresh.select(*KEYS, *[F.col(c).alias(f"_new_{c}") for c in cols if c in fresh.columns])
    both = old.join(new, KEYS, "full")

    def merged(c: str):
        sides = [f"_old_{c}", f"_new_{c}"] if c.endswith("_pred") else [f"_new_{c}", f"_old_{c}"]
        return F.coalesce(*[F.col(s) for s in sides if s in both.columns]).alias(c)

    return prune(both.select(*KEYS, *[merged(c) for c in cols]), keep_days)


def merge_predictions(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Long form (zone, ts_utc, model, pred): fresh rows only where the store has none yet."""
    keys = [*KEYS, "model"]
    known = store.where(F.col("pred").isNotNull())
    return known.unionByName(fresh.join(known, keys, "left_anti").select(*known.columns))


def merge_actuals(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Long form (zone, ts_utc, metered, verified): verified beats unverified, then the newest."""
    rows = store.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    order = F.struct(F.col("metered").isNotNull(), F.col("verified"), F.col("_new"))
    best = rows.groupBy(*KEYS).agg(F.max_by(F.struct("metered", "verified"), order).alias("_b"))
    return best.select(*KEYS, "_b.metered", "_b.verified")


def pivot_store(preds: DataFrame, actuals: DataFrame, models: Sequence[str]) -> DataFrame:
    """The wide view of the long store for a known list of models."""
    wide = preds.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"{m}_pred") for m in models])
    return wide.join(actuals.select(*KEYS, "metered"), KEYS, "full")


def select_models(preds: DataFrame, registry: DataFrame, klass: str | None = None,
                  families: Sequence[str] | None = None) -> DataFrame:
    """Predictions of the models of a class and of some families, with the registry's order.

    ``registry``: (model, klass, family, position). A model missing from it is an error row in
    ``unknown_models``.
    """
    keep = registry
    if klass is not None:
        keep = keep.where(F.col("klass") == klass)
    if families is not None:
        keep = keep.where(F.col("family").isin(*families))
    return preds.join(F.broadcast(keep), "model")  # one row a model, whatever Spark guesses of the predictions


def unknown_models(preds: DataFrame, registry: DataFrame) -> DataFrame:
    """Models with predictions that the registry does not list."""
    return preds.select("model").distinct().join(F.broadcast(registry), "model", "left_anti")
