"""Flagship, baseline and score queries."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hourcast.operators import metrics as M
from hourcast.operators.baseline import baseline
from hourcast.operators.quality import contiguity_report
from hourcast.operators.samples import sample_index
from hourcast.plans.evaluate import naive_scoreboard

from .registry import query, rnd
from .views import CFG, ERRORS, HOURLY, errors, errors_sql, hourly, index_sql, r6, ts_text

WEEK = replace(CFG, lookback=168, history=168)


def score_sql(source: str, by: str) -> str:
    """mape, mae, rmse, me, brs, peak_mape of ``source`` per ``by``."""
    edges = ", ".join(str(i / 10) for i in range(11))
    return f""",
edges AS (SELECT {by}, quantile_cont(true_load, [{edges}]) AS q FROM {source} GROUP BY ALL),
binned AS (
  SELECT s.*, e.q AS q, len(list_filter(list_distinct(e.q[2:10]), lambda x: x < s.true_load AND x > e.q[1])) AS bin
  FROM {source} s JOIN edges e USING ({by})),
bins AS (SELECT {by}, bin, AVG(true_load) AS c, AVG(signed_error) AS r FROM binned GROUP BY ALL),
slope AS (SELECT {by}, regr_slope(r, c) AS brs FROM bins GROUP BY ALL),
board AS (
  SELECT {by}, AVG(abs_error / true_load) * 100 AS mape, AVG(abs_error) AS mae,
    SQRT(AVG(signed_error * signed_error)) AS rmse, AVG(signed_error) AS me,
    AVG(CASE WHEN true_load >= q[10] THEN abs_error / true_load END) * 100 AS peak_mape, COUNT(*) AS n_hours
  FROM binned GROUP BY ALL)"""


BOARD = """
SELECT {by}, ROUND(mape, 6) AS mape, ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse, ROUND(me, 6) AS me,
  ROUND(brs, 6) AS brs, ROUND(peak_mape, 6) AS peak_mape, n_hours,
  CASE WHEN me > 0 THEN 'over' ELSE 'under' END AS bias
FROM board JOIN slope USING ({by})"""


def board(df, by=("zone", "model")):
    return df.select(*by, *[r6(c) for c in ("mape", "mae", "rmse", "me", "brs", "peak_mape")],
                     F.col("n_hours").cast("bigint").alias("n_hours"), "bias")


@query("flagship_naive_scoreboard",
       "WITH " + errors_sql(168, 168) + score_sql("errors", "zone, model") + BOARD.format(by="zone, model"))
def flagship(spark, d):
    return board(naive_scoreboard(hourly(spark, d), WEEK))


BASE_SELECT = "SELECT zone, strftime(target_day, '%Y-%m-%d') AS target_day, slot AS hour, ROUND(b, 6) AS base FROM "


def _exploded(df):
    long = df.select("zone", "target_day", F.posexplode("base").alias("hour", "base"))
    return long.select("zone", F.col("target_day").cast("string").alias("target_day"), "hour", r6("base"))


@query("baseline_hourly", "WITH " + ERRORS + BASE_SELECT + "base")
def baseline_hourly(spark, d):
    h = hourly(spark, d)
    index = sample_index(h, CFG).where("status = 'ok'")
    return _exploded(baseline(h, index, CFG.lookback, position="clock"))


@query("baseline_positional", "WITH " + HOURLY + index_sql() + """,
b0 AS (
  SELECT i.zone, i.target_day, (48 - (i.cutoff - h.p)) % 24 AS slot, AVG(h.load_est) AS b
  FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 48 GROUP BY 1, 2, 3)
""" + BASE_SELECT + "b0")
def baseline_positional(spark, d):
    h = hourly(spark, d)
    index = sample_index(h, CFG).where("status = 'ok'")
    return _exploded(baseline(h, index, CFG.lookback, positional=True, position="clock"))


@query("baseline_scalar", "WITH " + HOURLY + index_sql() + """,
b0 AS (
  SELECT i.zone, i.target_day, unnest(range(24)) AS slot, AVG(h.load_est) AS b
  FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 48
  GROUP BY 1, 2)
""" + BASE_SELECT + "b0")
def baseline_scalar(spark, d):
    h = hourly(spark, d)
    index = sample_index(h, CFG).where("status = 'ok'")
    return _exploded(baseline(h, index, CFG.lookback, mode="scalar", position="clock"))


@query("score_error_rows", "WITH " + ERRORS + """
SELECT zone, model, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, hour,
  ROUND(true_load, 6) AS true_load, ROUND(pred, 6) AS pred, ROUND(signed_error, 6) AS signed_error,
  ROUND(abs_error, 6) AS abs_error, ROUND(mape_pct, 6) AS mape_pct, day_of_week, day_of_month
FROM errors""")
def score_error_rows(spark, d):
    return errors(spark, d).select(
        "zone", "model", ts_text("datetime").alias("datetime"), "hour",
        *[r6(c) for c in ("true_load", "pred", "signed_error", "abs_error", "mape_pct")],
        "day_of_week", "day_of_month")


@query("score_basic", "WITH " + ERRORS + """
SELECT zone, model, ROUND(AVG(abs_error / true_load) * 100, 6) AS mape, ROUND(AVG(abs_error), 6) AS mae,
  ROUND(SQRT(AVG(signed_error * signed_error)), 6) AS rmse, ROUND(AVG(signed_error), 6) AS me,
  COUNT(*) AS n_hours, CASE WHEN AVG(signed_error) > 0 THEN 'over' ELSE 'under' END AS bias
FROM errors GROUP BY 1, 2""")
def score_basic(spark, d):
    b = M.basic_scores(errors(spark, d))
    return b.select("zone", "model", *[r6(c) for c in ("mape", "mae", "rmse", "me")], "n_hours", "bias")


@query("score_brs", "WITH " + ERRORS + score_sql("errors", "zone, model") + """
SELECT zone, model, ROUND(brs, 6) AS brs FROM slope""")
def score_brs(spark, d):
    return M.binned_residual_slope(errors(spark, d)).select("zone", "model", r6("brs"))


@query("score_peak", "WITH " + ERRORS + """,
lim AS (SELECT zone, quantile_cont(true_load, 0.9) AS q FROM errors GROUP BY 1)
SELECT zone, model, ROUND(AVG(abs_error / true_load) * 100, 6) AS peak_mape
FROM errors JOIN lim USING (zone) WHERE true_load >= q GROUP BY 1, 2""")
def score_peak(spark, d):
    return M.peak_mape(errors(spark, d)).select("zone", "model", r6("peak_mape"))


@query("score_all_zones", "WITH " + ERRORS + score_sql("errors", "model") + BOARD.format(by="model"))
def score_all_zones(spark, d):
    """One group over all zones: the exact quantiles of the whole table."""
    return board(M.scoreboard(errors(spark, d), ["model"]), ["model"])


for _key, _sql in {"hour": "hour", "day_of_week": "day_of_week", "day_of_month": "day_of_month",
                   "date": "date"}.items():
    _out = f"strftime({_sql}, '%Y-%m-%d')" if _key == "date" else _sql

    @query(f"score_by_{_key}", "WITH " + ERRORS + f"""
SELECT zone, model, {_out} AS {_key}, ROUND(AVG(mape_pct), 6) AS mape_pct, ROUND(AVG(signed_error), 6) AS bias,
  COUNT(*) AS n FROM errors GROUP BY ALL""")
    def score_by(spark, d, key=_key):
        p = M.error_profile(errors(spark, d), key, key)
        k = F.col(key).cast("string").alias(key) if key == "date" else F.col(key)
        return p.select("zone", "model", k, r6("mape_pct"), r6("bias"), "n")


@query("score_month_bias", "WITH " + ERRORS + """
SELECT zone, model, strftime(date_trunc('month', date), '%Y-%m-%d') AS month, ROUND(AVG(mape_pct), 6) AS mape_pct,
  ROUND(AVG(signed_error), 6) AS bias, COUNT(*) AS n FROM errors GROUP BY ALL""")
def score_month_bias(spark, d):
    return M.month_bias(errors(spark, d)).select(
        "zone", "model", F.col("month").cast("string").alias("month"), r6("mape_pct"), r6("bias"), "n")


@query("score_pred_deciles", "WITH " + ERRORS + """,
e AS (SELECT zone, quantile_cont(pred, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q FROM errors GROUP BY 1),
b AS (SELECT s.*, len(list_filter(list_distinct(e.q[2:10]), lambda x: x < s.pred AND x > e.q[1])) AS bin
      FROM errors s JOIN e USING (zone))
SELECT zone, model, bin, ROUND(AVG(pred), 6) AS centre, ROUND(AVG(signed_error), 6) AS resid, COUNT(*) AS n
FROM b GROUP BY ALL""")
def score_pred_deciles(spark, d):
    b = M.bin_means(errors(spark, d), "pred")
    return b.select("zone", "model", "bin", r6("centre"), r6("resid"), "n")


@query("score_best_worst_days", "WITH " + ERRORS + """,
dm AS (SELECT zone, date, AVG(mape_pct) AS m FROM errors GROUP BY 1, 2),
pl AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY ROUND(m, 9) DESC, date) AS w,
              ROW_NUMBER() OVER (PARTITION BY zone ORDER BY ROUND(m, 9), date) AS b FROM dm),
pick AS (SELECT zone, date, m, 'worst' AS kind, w AS place FROM pl WHERE w <= 3
         UNION ALL SELECT zone, date, m, 'best', b FROM pl WHERE b <= 3)
SELECT zone, model, kind, place, strftime(date, '%Y-%m-%d') AS date, hour, ROUND(m, 6) AS daily_mape,
  ROUND(true_load, 6) AS true_load, ROUND(pred, 6) AS pred FROM errors JOIN pick USING (zone, date)""")
def score_best_worst_days(spark, d):
    b = M.best_worst_days(errors(spark, d))
    return b.select("zone", "model", "kind", "place", F.col("date").cast("string").alias("date"), "hour",
                    r6("daily_mape"), r6("true_load"), r6("pred"))


@query("score_histogram", "WITH " + ERRORS + """,
s AS (SELECT zone, model, MIN(signed_error) AS lo, MAX(signed_error) AS hi FROM errors GROUP BY 1, 2),
k AS (SELECT zone, model, LEAST(CAST(floor((signed_error - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin, lo, hi
      FROM errors JOIN s USING (zone, model))
SELECT zone, model, bin, ROUND(lo + bin * (hi - lo) / 50, 5) AS left_edge, COUNT(*) AS n FROM k GROUP BY zone, model, bin, lo, hi""")
def score_histogram(spark, d):
    h = M.error_histogram(errors(spark, d))
    return h.select("zone", "model", "bin", rnd("left_edge", 5).alias("left_edge"), "n")


@query("score_cdf", "WITH " + ERRORS + """
SELECT zone, model, ROUND(signed_error, 6) AS signed_error, ROUND(row_number() OVER (
    PARTITION BY zone, model ORDER BY signed_error) * 100.0::DOUBLE / COUNT(*) OVER (PARTITION BY zone, model), 6) AS cdf
FROM errors""")
def score_cdf(spark, d):
    return M.error_cdf(errors(spark, d)).select("zone", "model", r6("signed_error"), r6("cdf"))


@query("score_percentiles", "WITH " + ERRORS + """
SELECT zone, model, ROUND(quantile_cont(signed_error, 0.1), 6) AS p10, ROUND(quantile_cont(signed_error, 0.5), 6) AS p50,
  ROUND(quantile_cont(signed_error, 0.9), 6) AS p90,
  ROUND(quantile_cont(signed_error / true_load * 100, 0.1), 6) AS pct10,
  ROUND(quantile_cont(signed_error / true_load * 100, 0.5), 6) AS pct50,
  ROUND(quantile_cont(signed_error / true_load * 100, 0.9), 6) AS pct90
FROM errors GROUP BY 1, 2""")
def score_percentiles(spark, d):
    e = errors(spark, d)
    mw = M.error_percentiles(e)
    pct = M.error_percentiles(e, M.signed_pct()).withColumnsRenamed({"p10": "pct10", "p50": "pct50", "p90": "pct90"})
    out = mw.join(pct, ["zone", "model"])
    return out.select("zone", "model", *[r6(c) for c in ("p10", "p50", "p90", "pct10", "pct50", "pct90")])


@query("regime_scoreboard", "WITH " + ERRORS + """,
reg AS (SELECT *, CASE WHEN month(date) IN (7, 8) THEN 'summer' WHEN month(date) IN (6, 9) THEN 'upper_shoulder'
    WHEN month(date) IN (3, 4, 5, 10, 11) THEN 'shoulder' ELSE 'winter' END AS season,
    CASE WHEN hour <= 4 THEN 'low' WHEN hour IN (6, 7, 8, 9, 17, 18, 19, 20) THEN 'peak' ELSE 'high' END AS expert
  FROM errors)
SELECT zone, model, season, expert, ROUND(AVG(abs_error / true_load) * 100, 6) AS mape,
  COUNT(DISTINCT date) AS n_days, COUNT(DISTINCT hour) AS n_owned_hours FROM reg GROUP BY ALL""")
def regime_scoreboard(spark, d):
    """The hourly view lies in shoulder months only, so the SQL map spells out that season."""
    b = M.regime_scoreboard(errors(spark, d))
    return b.select("zone", "model", "season", "expert", r6("mape"), "n_days", "n_owned_hours")


@query("regime_expert_suite", "WITH " + ERRORS + """,
reg AS (SELECT *, 'shoulder' AS season,
    CASE WHEN hour <= 4 THEN 'low' WHEN hour IN (6, 7, 8, 9, 17, 18, 19, 20) THEN 'peak' ELSE 'high' END AS expert
  FROM errors)""" + score_sql("reg", "zone, model, season, expert") + BOARD.format(by="zone, model, season, expert"))
def regime_expert_suite(spark, d):
    return board(M.expert_scoreboard(errors(spark, d)), ["zone", "model", "season", "expert"])


@query("clean_gate", "WITH " + HOURLY + """
SELECT zone, COUNT(*) AS n_gaps, strftime(MIN(ts_utc), '%Y-%m-%d %H:%M:%S') AS first_gap FROM (
  SELECT zone, ts_utc, p - LAG(p) OVER (PARTITION BY zone ORDER BY p) AS step FROM hourly
  WHERE h % 37 <> 0) WHERE step <> 1 GROUP BY 1""")
def clean_gate(spark, d):
    """Gate report of a series with holes punched at every 37th hour."""
    r = contiguity_report(hourly(spark, d).where("h % 37 <> 0"))
    return r.select("zone", "n_gaps", ts_text("first_gap").alias("first_gap"))
