"""Error tables and scores. ``by`` is the grouping, (zone, model) unless said otherwise."""
from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .chunks import salted_join
from .quantiles import at_or_above, bin_of_rank, group_ranks, quantiles, value_ranks
from .regimes import add_regime

BY = ("zone", "model")
EPS = sys.float_info.epsilon


def error_rows(pred: DataFrame, y: str = "y", yhat: str = "yhat",
               hours: Sequence[int] | None = None) -> DataFrame:
    """(zone, model, target_day, y[24], yhat[24]) -> one row per hour slot."""
    pairs = F.arrays_zip(F.col(y).alias("true_load"), F.col(yhat).alias("pred"))
    long = pred.select("zone", "model", "target_day", F.posexplode(pairs).alias("hour", "_e"))
    if hours is not None:
        long = long.where(F.col("hour").isin(*hours))
    base = long.select(
        "zone", "model", F.col("target_day").alias("date"), "hour",
        (F.col("target_day").cast("timestamp_ntz")
         + F.make_dt_interval(hours=F.col("hour"))).alias("datetime"),
        F.col("_e.true_load").alias("true_load"), F.col("_e.pred").alias("pred"))
    return add_errors(base)


def add_errors(df: DataFrame, true: str = "true_load", pred: str = "pred",
               when: str = "datetime") -> DataFrame:
    """signed_error, abs_error, mape_pct and the calendar keys of the error table."""
    err = F.col(pred) - F.col(true)
    return df.withColumns({
        "signed_error": err, "abs_error": F.abs(err),
        "mape_pct": F.try_divide(F.abs(err), F.col(true)) * 100,
        "day_of_week": F.weekday(when), "day_of_month": F.dayofmonth(when)})


def ape(true: Column, pred: Column) -> Column:
    """Absolute percentage error with the denominator kept off zero."""
    return F.abs(pred - true) / F.greatest(F.abs(true), F.lit(EPS))


def score_columns() -> list[Column]:
    e = F.col("pred") - F.col("true_load")
    return [
        (F.avg(ape(F.col("true_load"), F.col("pred"))) * 100).alias("mape"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("me"),
        F.count(e).alias("n_hours")]


def _scored(errors: DataFrame) -> DataFrame:
    return errors.where(F.col("true_load").isNotNull() & F.col("pred").isNotNull())


def basic_scores(errors: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """MAPE, MAE, RMSE, ME and the bias label, in one pass."""
    out = _scored(errors).groupBy(*by).agg(*score_columns())
    return out.withColumn("bias", F.when(F.col("me") > 0, "over").otherwise("under"))


def bin_means(errors: DataFrame, value: str = "true_load", bins: int = 10,
              by: Sequence[str] = BY) -> DataFrame:
    """Mean value and mean signed error per equal-frequency bin; bins are numbered in order."""
    ranked = value_ranks(_scored(errors), by, value, {"_e": F.sum(F.col("pred") - F.col("true_load"))})
    means = (ranked.withColumn("_bin", bin_of_rank(bins)).groupBy(*by, "_bin").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("centre"),
        (F.sum("_e") / F.sum("n")).alias("resid"), F.sum("n").alias("n")))
    place = F.row_number().over(W.partitionBy(*by).orderBy("_bin")) - 1
    return means.withColumn("bin", place).drop("_bin")


def binned_residual_slope(errors: DataFrame, bins: int = 10, by: Sequence[str] = BY) -> DataFrame:
    """OLS slope of the bin means: positive means over-prediction at high load."""
    return bin_means(errors, "true_load", bins, by).groupBy(*by).agg(
        F.regr_slope("resid", "centre").alias("brs"))


def peak_mape(errors: DataFrame, q: float = 0.9, by: Sequence[str] = BY) -> DataFrame:
    """MAPE over the hours at or above the q-quantile of the actual load."""
    ranked = value_ranks(_scored(errors), by, "true_load",
                         {"_a": F.sum(ape(F.col("true_load"), F.col("pred")))})
    return ranked.where(at_or_above(q)).groupBy(*by).agg(
        (F.sum("_a") / F.sum("n") * 100).alias("peak_mape"))


def scoreboard(errors: DataFrame, by: Sequence[str] = BY, bins: int = 10,
               peak: float = 0.9) -> DataFrame:
    """Basic scores, BRS and peak MAPE from one reduction of the rows to distinct actuals."""
    by = list(by)
    a, e = ape(F.col("true_load"), F.col("pred")), F.col("pred") - F.col("true_load")
    ranked = value_ranks(_scored(errors), by, "true_load", {
        "_a": F.sum(a), "_ae": F.sum(F.abs(e)), "_se": F.sum(e * e), "_e": F.sum(e)})
    high = at_or_above(peak)
    per_bin = ranked.withColumn("_bin", bin_of_rank(bins)).groupBy(*by, "_bin").agg(
        *[F.sum(c).alias(c) for c in ("n", "_a", "_ae", "_se", "_e")],
        F.sum(F.when(high, F.col("_a"))).alias("_pa"), F.sum(F.when(high, F.col("n"))).alias("_pn"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("_c"),
        (F.sum("_e") / F.sum("n")).alias("_r"))
    n = F.sum("n")
    out = per_bin.groupBy(*by).agg(
        (F.sum("_a") / n * 100).alias("mape"), (F.sum("_ae") / n).alias("mae"),
        F.sqrt(F.sum("_se") / n).alias("rmse"), (F.sum("_e") / n).alias("me"),
        F.regr_slope("_r", "_c").alias("brs"),
        (F.sum("_pa") / F.sum("_pn") * 100).alias("peak_mape"), n.alias("n_hours"))
    return out.withColumn("bias", F.when(F.col("me") > 0, "over").otherwise("under"))


def error_profile(errors: DataFrame, key: str | Column, name: str,
                  by: Sequence[str] = BY) -> DataFrame:
    """Mean MAPE and mean bias per key (hour, day_of_week, day_of_month, date, month, ...)."""
    k = F.col(key) if isinstance(key, str) else key
    return errors.groupBy(*by, k.alias(name)).agg(
        F.avg("mape_pct").alias("mape_pct"), F.avg("signed_error").alias("bias"),
        F.count(F.lit(1)).alias("n"))


def month_bias(errors: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean bias per calendar month."""
    return error_profile(errors, F.trunc(F.to_date("datetime"), "month"), "month", by)


def daily_mape(errors: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return errors.groupBy(*by, "date").agg(F.avg("mape_pct").alias("daily_mape"))


def best_worst_days(errors: DataFrame, k: int = 3, by: Sequence[str] = BY) -> DataFrame:
    """The k best and k worst days with their hourly curves: adds kind, place, daily_mape."""
    days = daily_mape(errors, by)
    w = W.partitionBy(*by)
    placed = days.withColumns({
        "_w": F.row_number().over(w.orderBy(F.desc("daily_mape"), "date")),
        "_b": F.row_number().over(w.orderBy("daily_mape", "date"))})
    worst = placed.where(F.col("_w") <= k).withColumn("kind", F.lit("worst")).withColumn("place", F.col("_w"))
    best = placed.where(F.col("_b") <= k).withColumn("kind", F.lit("best")).withColumn("place", F.col("_b"))
    picked = worst.unionByName(best).drop("_w", "_b")
    return errors.join(picked, [*by, "date"])


def error_histogram(errors: DataFrame, bins: int = 50, value: str | Column = "signed_error",
                    by: Sequence[str] = BY) -> DataFrame:
    """Equal-width bins between a group's min and max; the last bin is closed on the right."""
    v = F.col(value) if isinstance(value, str) else value
    rows = errors.select(*by, "datetime", v.alias("_v")).where(F.col("_v").isNotNull())
    span = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    k = F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), width), F.lit(0.0)) * bins),
                F.lit(bins - 1))
    counted = salted_join(rows, span, list(by), ["datetime"]).groupBy(*by, "_lo", "_hi", k.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    step = width / bins
    return counted.select(*by, "bin", (F.col("_lo") + F.col("bin") * step).alias("left_edge"),
                          (F.col("_lo") + (F.col("bin") + 1) * step).alias("right_edge"), "n")


def signed_pct() -> Column:
    """Signed error in percent of the actual."""
    return F.try_divide(F.col("signed_error"), F.col("true_load")) * 100


def error_cdf(errors: DataFrame, value: str = "signed_error", by: Sequence[str] = BY,
              tie: str = "datetime") -> DataFrame:
    """Empirical CDF in percent: rank / n * 100 with every row its own step."""
    ranked = group_ranks(errors, by, value, tie, "_rank", "_size")
    return ranked.withColumn("cdf", F.col("_rank") / F.col("_size") * 100).drop("_rank", "_size")


def error_percentiles(errors: DataFrame, value: str | Column = "signed_error",
                      probs: Sequence[float] = (0.1, 0.5, 0.9), by: Sequence[str] = BY) -> DataFrame:
    """Exact percentiles of the error: columns p10, p50, ..."""
    q = quantiles(errors, by, value, probs, "_q")
    return q.select(*by, *[F.col("_q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probs)])


def rank_models(errors: DataFrame) -> DataFrame:
    """Rank of each model per zone and day by daily MAPE (1 = best)."""
    w = W.partitionBy("zone", "date").orderBy("daily_mape")
    return daily_mape(errors).withColumn("rank", F.rank().over(w))


def regime_scoreboard(errors: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """MAPE per (season, expert) with day and owned-hour counts."""
    tagged = add_regime(errors, day="date")
    return tagged.groupBy(*by, "season", "expert").agg(
        (F.avg(ape(F.col("true_load"), F.col("pred"))) * 100).alias("mape"),
        F.count_distinct("date").alias("n_days"), F.count_distinct("hour").alias("n_owned_hours"))


def expert_scoreboard(errors: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The whole score suite on every expert's slice."""
    return scoreboard(add_regime(errors, day="date"), [*by, "season", "expert"])


def with_baseline(pred: DataFrame, base: str = "base") -> DataFrame:
    """Predictions plus the baseline they lean on, as one more model."""
    naive = pred.withColumn("yhat", F.col(base)).withColumn("model", F.lit("baseline"))
    keep = ["zone", "model", "target_day", "y", "yhat"]
    return pred.select(*keep).unionByName(naive.select(*keep).dropDuplicates(["zone", "target_day"]))


def store_errors(preds: DataFrame, metered: DataFrame, tz: str | None = None) -> DataFrame:
    """Store rows with both values: (zone, ts_utc, model, pred) joined to (zone, ts_utc, metered)."""
    # Both sides are hours of all zones. Where they are exploded from spans, Spark guesses too little and would broadcast one.
    known = metered.where(F.col("metered").isNotNull()).hint("merge")
    return (preds.join(known, ["zone", "ts_utc"])
            .withColumn("true_load", F.col("metered"))
            .withColumn("signed_error", F.col("pred") - F.col("metered")))


def store_scoreboard(preds: DataFrame, metered: DataFrame, rounded_scores: bool = True) -> DataFrame:
    """Scored-window table per zone and model, rounded as shown to readers (2 digits, BRS 4)."""
    rounded = (preds.withColumn("pred", F.round("pred", 1)),
               metered.withColumn("metered", F.round("metered", 1)))
    board = scoreboard(store_errors(*rounded))
    digits = {"mape": 2, "mae": 2, "rmse": 2, "me": 2, "brs": 4}
    scores = [F.round(c, n).alias(c) if rounded_scores else F.col(c) for c, n in digits.items()]
    return board.select("zone", "model", *scores, F.col("n_hours").alias("hours"))


def day_status(metered: DataFrame) -> DataFrame:
    """(zone, date, status): 'scored' if any hour of the local day has an actual, else 'day_ahead'."""
    days = metered.groupBy("zone", F.to_date("ts_local").alias("date")).agg(
        F.count("metered").alias("n_actual"))
    return days.withColumn("status", F.when(F.col("n_actual") > 0, "scored").otherwise("day_ahead"))
