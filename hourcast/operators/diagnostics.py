"""Feature and error diagnostics as tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import name_family, name_lag
from .chunks import keep_first
from .metrics import BY
from .quantiles import group_ranks
from .regimes import season_of
from .rolling import rolling_time_mean
from .samples import channel_mean

SCALARS = {
    "calendar": ["tmrw_month_sin", "tmrw_month_cos", "tmrw_dow_sin", "tmrw_dow_cos",
                 "tmrw_is_weekend", "tmrw_is_holiday"],
}


# ---- importance ----------------------------------------------------------------------------

def _parts(imp: DataFrame, sequence: Sequence[str]) -> DataFrame:
    seq = F.array(*[F.lit(s.lower()) for s in sequence])
    return imp.withColumns({"family": name_family(F.col("name"), seq),
                            "lag": name_lag(F.col("name"), seq)})


def importance_by_family(imp: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """(family, importance, pct, n_cols): lags of a sequence column collapsed. ``imp`` is
    (name, importance); only names of ``sequence`` columns carry a lag."""
    fam = _parts(imp, sequence).groupBy("family").agg(
        F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("n_cols"))
    return _with_share(fam)


def _with_share(df: DataFrame) -> DataFrame:
    total = df.agg(F.sum("importance")).scalar()
    return df.withColumn("pct", F.try_divide(F.col("importance"), total) * 100)


def static_importance(imp: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """Columns without a lag, with their share of the whole."""
    return _with_share(_parts(imp, sequence)).where(F.col("lag").isNull()).select(
        "name", "importance", "pct")


def importance_by_lag(imp: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """(lag, importance) over the sequence columns."""
    return (_parts(imp, sequence).where(F.col("lag").isNotNull())
            .groupBy("lag").agg(F.sum("importance").alias("importance")))


def top_columns(imp: DataFrame, k: int = 30) -> DataFrame:
    """The k columns of highest importance."""
    return imp.orderBy(F.desc("importance"), "name").limit(k)


def sum_importance(per_model: DataFrame) -> DataFrame:
    """(model_hour, name, importance) -> (name, importance) over all hourly models."""
    return per_model.groupBy("name").agg(F.sum("importance").alias("importance"))


# ---- features against the target -----------------------------------------------------------

def with_features(samples: DataFrame, seq_cols: Sequence[str]) -> DataFrame:
    """``features``: name and value of each, to be written instead of the window when they are read more than once."""
    means = [F.struct(F.lit(c.lower()).alias("name"), channel_mean(j).alias("value"))
             for j, c in enumerate(seq_cols)]
    scalars = [F.struct(F.lit(c).alias("name"), F.col("calendar")[i].alias("value"))
               for i, c in enumerate(SCALARS["calendar"])]
    return samples.withColumn("features", F.array(*means, *scalars))


def feature_values(samples: DataFrame, seq_cols: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(zone, target_day, name, value): window mean per sequence column, raw calendar scalars; columns ``carry`` ride along."""
    rows = samples if "features" in samples.columns else with_features(samples, seq_cols)
    return (rows.select("zone", "target_day", *carry, F.explode("features").alias("_e"))
            .select("zone", "target_day", *carry, "_e.name", "_e.value"))


def target_value(samples: DataFrame, hour: int | None = None) -> DataFrame:
    """(zone, target_day, load): the daily mean of y, or one hour of it."""
    return with_target(samples, hour).select("zone", "target_day", "load")


def with_target(samples: DataFrame, hour: int | None = None) -> DataFrame:
    """``load`` beside all else of a sample, as ``target_value`` has it."""
    y = (F.aggregate("y", F.lit(0.0), lambda a, v: a + v) / F.size("y") if hour is None
         else F.get("y", hour))
    return samples.withColumn("load", y)


def feature_relations(values: DataFrame, target: DataFrame | None = None, power: int = 1,
                      by: Sequence[str] = ("zone",)) -> DataFrame:
    """Pearson r and the OLS line of load on value ** power, per feature, in one aggregation. Without ``target`` the values
    carry their ``load``, and no value is joined."""
    x = F.pow("value", F.lit(float(power))) if power != 1 else F.col("value")
    joined = ((values if target is None else values.join(target, ["zone", "target_day"]))
              .where(F.col("value").isNotNull() & F.col("load").isNotNull()).withColumn("_x", x))
    return joined.groupBy(*by, "name").agg(
        F.corr("_x", "load").alias("r"), F.regr_slope("load", "_x").alias("slope"),
        F.regr_intercept("load", "_x").alias("intercept"), F.count(F.lit(1)).alias("n"))


def season_relations(values: DataFrame, target: DataFrame,
                     by: Sequence[str] = ("zone",)) -> DataFrame:
    """Pearson r per feature and season of the target day."""
    joined = values.join(target, ["zone", "target_day"]).withColumn(
        "season", season_of(F.month("target_day")))
    return joined.groupBy(*by, "season", "name").agg(
        F.corr("value", "load").alias("r"), F.count(F.lit(1)).alias("n"))


def dead_features(values: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Features that never vary: min equals max."""
    return (values.groupBy(*by, "name").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
            .where(F.col("_lo") == F.col("_hi")).select(*by, "name", F.col("_lo").alias("value")))


def correlation_matrix(values: DataFrame, names: Sequence[str],
                       by: Sequence[str] = ("zone",)) -> DataFrame:
    """(a, b, r) for each ordered pair of the named features: d*d/2 aggregates over one pass."""
    wide = (values.where(F.col("name").isin(*names))
            .groupBy(*dict.fromkeys([*by, "zone", "target_day"]))
            .agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"f{i}")
                   for i, n in enumerate(names)]))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    one = wide.groupBy(*by).agg(*[F.corr(f"f{i}", f"f{j}").alias(f"r{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(names[a]).alias("a"), F.lit(names[b]).alias("b"),
                      F.col(f"r{i}_{j}").alias("r"))
             for i, j in pairs for a, b in {(i, j), (j, i)}]
    return one.select(*by, F.explode(F.array(*cells)).alias("_e")).select(*by, "_e.*")


def common_keys(x: DataFrame, y: DataFrame) -> DataFrame:
    """Features and targets on the sample keys both have."""
    return x.join(y, ["zone", "target_day"])


# ---- errors --------------------------------------------------------------------------------

def tail_error_hours(errors: DataFrame, frac: float = 0.1, by: Sequence[str] = BY) -> DataFrame:
    """Hour distribution of the most over- and under-predicted rows, with lift over all rows."""
    ranked = group_ranks(errors, by, "signed_error", "datetime", "_up", "_n")
    k = F.greatest(F.lit(1), F.rint(F.col("_n") * frac).cast("bigint"))
    tagged = ranked.withColumns({"_k": k, "_over": F.col("_up") > F.col("_n") - k,
                                 "_under": F.col("_up") <= k})
    counts = tagged.groupBy(*by, "hour", "_n", "_k").agg(
        F.count(F.lit(1)).alias("_all"), F.sum(F.col("_over").cast("int")).alias("over"),
        F.sum(F.col("_under").cast("int")).alias("under"))
    long = counts.select(*by, "hour", "_n", "_k", "_all", F.explode(F.array(
        F.struct(F.lit("over").alias("tail"), F.col("over").alias("n")),
        F.struct(F.lit("under").alias("tail"), F.col("under").alias("n")))).alias("_e"))
    share = F.col("_e.n") / F.col("_k")
    base = F.col("_all") / F.col("_n")
    return long.where(F.col("_e.n") > 0).select(
        *by, "_e.tail", "hour", "_e.n", share.alias("share"), base.alias("base_share"),
        (share / base).alias("lift"))


def estimate_quality(df: DataFrame) -> DataFrame:
    """Preliminary against metered load per zone: mean, std, MAE, MAPE, range."""
    e = F.col("load_est") - F.col("load")
    rows = df.where(F.col("load").isNotNull() & F.col("load_est").isNotNull())
    return rows.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error"),
        F.avg(F.abs(e)).alias("mae"), (F.avg(F.try_divide(F.abs(e), F.col("load"))) * 100).alias("mape"),
        F.min(e).alias("min_error"), F.max(e).alias("max_error"))


def estimate_trend(df: DataFrame, days: int = 7, ts: str = "ts_local") -> DataFrame:
    """Seven-day time mean of the signed and absolute estimate error, on the wall clock."""
    rows = df.where(F.col("load").isNotNull() & F.col("load_est").isNotNull())
    e = F.col("load_est") - F.col("load")
    keyed = rows.withColumn("_wall", F.col(ts).cast("timestamp"))
    out = rolling_time_mean(keyed, {"trend": e, "abs_trend": F.abs(e)}, days, "_wall")
    return out.drop("_wall")


def month_stats(df: DataFrame, value: str = "load", local: str = "ts_local") -> DataFrame:
    """Mean, variance, deviation and count per month."""
    return df.groupBy("zone", F.month(local).alias("month")).agg(
        F.avg(value).alias("mean"), F.var_samp(value).alias("var"),
        F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def month_hour_stats(df: DataFrame, value: str = "load", local: str = "ts_local",
                     stat: str = "mean") -> DataFrame:
    """Month x hour table of the mean or variance: one row per month, columns h0..h23."""
    fn = {"mean": F.avg, "var": F.var_samp}[stat]
    hour = F.hour(local)
    return df.groupBy("zone", F.month(local).alias("month")).agg(
        *[fn(F.when(hour == h, F.col(value))).alias(f"h{h}") for h in range(24)])


# ---- parity --------------------------------------------------------------------------------

def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str],
           atol: float = 1e-4) -> DataFrame:
    """Keys missing on a side, or whose values differ by more than ``atol``; empty on parity."""
    keys = list(keys)
    a = left.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(True).alias("_in_a"))
    b = right.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(True).alias("_in_b"))
    types = dict(left.dtypes)

    def gap(c: str) -> Column:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        if not types[c].startswith("array"):
            return F.coalesce(F.abs(x - y), F.when(x.isNull() != y.isNull(), float("inf")), F.lit(0.0))
        if types[c].startswith("array<array"):
            x, y = F.flatten(x), F.flatten(y)
        worst = F.array_max(F.zip_with(x, y, lambda p, q: F.when(
            p.isNull() & q.isNull(), 0.0).otherwise(F.coalesce(F.abs(p - q), F.lit(float("inf"))))))
        return F.coalesce(worst, F.lit(0.0))

    both = a.join(b, keys, "full").withColumn("max_diff", F.greatest(*[gap(c) for c in cols], F.lit(0.0)))
    state = (F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right")
             .when(F.col("max_diff") > atol, "differs"))
    return both.withColumn("issue", state).where(F.col("issue").isNotNull()).select(
        *keys, "issue", "max_diff")


def forecast_skill(fc: DataFrame, observed: DataFrame, time_col: str = "valid_local") -> DataFrame:
    """RMSE and bias of the forecast temperature by zone and lead day."""
    seen = keep_first(observed.select("zone", F.col("ts_local").alias(time_col),
                                      F.col("Temp_F").alias("_obs")), ["zone", time_col], ["_obs"])
    e = F.col("Temp_F") - F.col("_obs")
    return (fc.join(seen, ["zone", time_col]).where(e.isNotNull()).groupBy("zone", "lead_day")
            .agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
                 F.count(F.lit(1)).alias("n")))
