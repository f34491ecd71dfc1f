"""Splits, residuals and Spark ML queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.operators import baseline as B, metrics as M, models as ML, split as SP
from hourcast.operators.regimes import regime_map, regime_slice
from hourcast.operators.samples import day_targets, sample_index
from hourcast.plans.evaluate import naive_forecast
from hourcast.plans.training import fit_model, predict
from hourcast.sources.tables import stage

from .q_sample import DAY, day, exploded, samples_of
from .registry import query, rnd
from .views import CFG, ERRORS, HOURLY, errors, hourly, index_sql, r6

SPLIT = """,
s0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY target_day) - 1 AS no, COUNT(*) OVER (PARTITION BY zone) AS n FROM {src}),
s1 AS (SELECT *, CASE WHEN {test} THEN 'test' ELSE 'train' END AS sp FROM s0),
s2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone, sp ORDER BY target_day) - 1 AS no2, COUNT(*) OVER (PARTITION BY zone, sp) AS n2 FROM s1),
s3 AS (SELECT * EXCLUDE (sp), CASE WHEN sp = 'train' AND no2 >= n2 - floor(n2 * {val}) AND {val} > 0 THEN 'val' ELSE sp END AS sp FROM s2),
s4 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone, sp ORDER BY target_day DESC) AS e FROM s3),
spl AS (SELECT *, CASE WHEN sp IN ('train', 'val') AND e <= {emb} THEN 'embargo' ELSE sp END AS split FROM s4)"""
TAIL_TEST = "no >= n - floor(n * 0.3)"


def _days(spark, d):
    return sample_index(hourly(spark, d), CFG).where("status = 'ok'")


for _name, _kw, _sql in [
    ("split_tail", dict(strategy="tail", test_frac=0.3, embargo=0), dict(test=TAIL_TEST, val=0, emb=0)),
    ("split_head", dict(strategy="head", test_frac=0.3, embargo=0), dict(test="no < floor(n * 0.3)", val=0, emb=0)),
    ("embargo", dict(strategy="tail", test_frac=0.3, embargo=3), dict(test=TAIL_TEST, val=0, emb=3)),
    ("split_nested", dict(strategy="tail", test_frac=0.3, val_frac=0.4, embargo=2), dict(test=TAIL_TEST, val=0.4, emb=2)),
]:
    @query(_name, "WITH " + HOURLY + index_sql() + SPLIT.format(src="idx", **_sql) + f"""
SELECT zone, {DAY}, no AS sample_no, split FROM spl""")
    def split_query(spark, d, kw=_kw):
        return SP.split_samples(_days(spark, d), **kw).select("zone", day(), "sample_no", "split")


@query("split_random_sizes", "WITH " + HOURLY + index_sql() + """,
c AS (SELECT zone, COUNT(*) AS n FROM idx GROUP BY 1)
SELECT zone, 'test' AS split, CAST(floor(n * 0.3) AS BIGINT) AS n FROM c UNION ALL
SELECT zone, 'train', n - CAST(floor(n * 0.3) AS BIGINT) FROM c""")
def split_random(spark, d):
    """Membership follows this library's own seed; the sizes are fixed."""
    out = SP.split_samples(_days(spark, d), "random", 0.3, embargo=0)
    return out.groupBy("zone", "split").agg(F.count(F.lit(1)).alias("n"))


@query("split_fit_set", "WITH " + HOURLY + index_sql() + SPLIT.format(src="idx", test=TAIL_TEST, val=0, emb=3) + f""",
v AS (SELECT zone, ld, MIN(is_valid) AS ok FROM hourly GROUP BY 1, 2)
SELECT s.zone, {DAY} FROM spl s JOIN v ON v.zone = s.zone AND v.ld = s.target_day WHERE split = 'train' AND ok = 1""")
def split_fit_set(spark, d):
    """Validity filters the fit set only; the split itself counts every sample."""
    h = hourly(spark, d)
    ok = day_targets(h, "load", "clock").select("zone", "target_day", "is_target_valid")
    s = SP.split_samples(_days(spark, d), "tail", 0.3, embargo=3).join(ok, ["zone", "target_day"])
    return SP.fit_set(s).select("zone", day())


def _naive(spark, d):
    """(zone, target_day, y, base, is_target_valid) of every usable day."""
    h = hourly(spark, d)
    ok = day_targets(h, "load", "clock").select("zone", "target_day", "is_target_valid")
    return naive_forecast(h, CFG).withColumnRenamed("yhat", "base").join(ok, ["zone", "target_day"])


@query("residual_target", "WITH " + ERRORS + """
SELECT zone, strftime(date, '%Y-%m-%d') AS target_day, hour AS idx, ROUND(true_load - pred, 5) + 0.0 AS value FROM errors""")
def residual_target(spark, d):
    return exploded(B.residual_target(_naive(spark, d)), "residual", 5)


LABELLED = ERRORS + """,
dd AS (SELECT DISTINCT zone, date AS target_day FROM errors)""" + SPLIT.format(src="dd", test=TAIL_TEST, val=0, emb=3) + """,
vv AS (SELECT zone, ld, MIN(is_valid) AS ok FROM hourly GROUP BY 1, 2),
lab AS (SELECT e.*, s.split, vv.ok FROM errors e JOIN spl s ON s.zone = e.zone AND s.target_day = e.date
        JOIN vv ON vv.zone = e.zone AND vv.ld = e.date)"""


@query("residual_scaler", "WITH " + LABELLED + """
SELECT zone, 'residual' AS feature, ROUND(AVG(-signed_error), 5) AS mean, ROUND(stddev_pop(-signed_error), 5) AS scale
FROM lab WHERE split = 'train' AND ok = 1 GROUP BY 1""")
def residual_scaler(spark, d):
    s = SP.split_samples(_naive(spark, d), "tail", 0.3, embargo=3)
    out = B.fit_residual_scaler(SP.fit_set(B.residual_target(s)))
    return out.select("zone", "feature", rnd("mean", 5).alias("mean"), rnd("scale", 5).alias("scale"))


@query("residual_add_back", "WITH " + ERRORS + """
SELECT zone, strftime(date, '%Y-%m-%d') AS target_day, hour AS idx, ROUND(pred + (true_load - pred) * 0.5, 5) AS value FROM errors""")
def residual_add_back(spark, d):
    half = B.residual_target(_naive(spark, d)).withColumn("residual_hat", F.transform("residual", lambda r: r * 0.5))
    return exploded(B.add_back(half), "yhat", 5)


@query("score_vs_baseline", "WITH " + ERRORS + """,
two AS (SELECT zone, date, 'baseline' AS model, true_load AS y, pred AS p FROM errors
        UNION ALL SELECT zone, date, 'half', true_load, pred + (true_load - pred) * 0.5 FROM errors)
SELECT zone, model, ROUND(AVG(ABS(p - y) / y) * 100, 6) AS mape, ROUND(AVG(ABS(p - y)), 6) AS mae, ROUND(AVG(p - y), 6) + 0.0 AS me FROM two GROUP BY ALL""")
def score_vs_baseline(spark, d):
    """A model that halves the baseline's error, next to the baseline it leans on."""
    half = B.residual_target(_naive(spark, d)).withColumn("residual_hat", F.transform("residual", lambda r: r * 0.5))
    pred = B.add_back(half).withColumn("model", F.lit("half"))
    s = M.basic_scores(M.error_rows(M.with_baseline(pred)))
    return s.select("zone", "model", r6("mape"), r6("mae"), r6("me"))


@query("score_model_ranks", "WITH " + ERRORS + """,
two AS (SELECT zone, date, 'baseline' AS model, true_load AS y, pred AS p FROM errors
        UNION ALL SELECT zone, date, 'half', true_load, pred + (true_load - pred) * 0.5 FROM errors),
dm AS (SELECT zone, model, date, AVG(ABS(p - y) / y * 100) AS m FROM two GROUP BY ALL)
SELECT zone, model, strftime(date, '%Y-%m-%d') AS date, ROUND(m, 6) AS daily_mape, rank() OVER (PARTITION BY zone, date ORDER BY m) AS rank FROM dm""")
def score_model_ranks(spark, d):
    half = B.residual_target(_naive(spark, d)).withColumn("residual_hat", F.transform("residual", lambda r: r * 0.5))
    pred = B.add_back(half).withColumn("model", F.lit("half"))
    r = M.rank_models(M.error_rows(M.with_baseline(pred)))
    return r.select("zone", "model", day("date"), r6("daily_mape"), F.col("rank").cast("bigint").alias("rank"))


# ---- models --------------------------------------------------------------------------------

def _rows(spark, d, residual=False):
    """Labelled hourly rows with the baseline as the one feature."""
    s = SP.split_samples(_naive(spark, d), "tail", 0.3, embargo=3)
    cells = F.arrays_zip(F.col("y"), F.col("base"))
    rows = s.select("zone", "target_day", "split", "is_target_valid", F.posexplode(cells).alias("hour", "_e"))
    y, b = F.col("_e.y"), F.col("_e.base")
    rows = rows.select("zone", "target_day", "split", "is_target_valid", "hour", b.alias("base"), y.alias("y"),
                       (y - b if residual else y).alias("label"))
    return stage(rows, "rows", ["hour"])


def _ols(target, part):
    return LABELLED + f""",
tagged AS (SELECT *, CASE WHEN hour <= 4 THEN 'low' WHEN hour IN (6, 7, 8, 9, 17, 18, 19, 20) THEN 'peak' ELSE 'high' END AS expert FROM lab),
fit AS (SELECT {part}, regr_slope({target}, pred) AS a, regr_intercept({target}, pred) AS b FROM tagged WHERE split = 'train' AND ok = 1 GROUP BY 1)"""


def _plain():
    return ML.make_regressor("mse", regParam=0.0, solver="normal")


@query("ml_linear_hourly", "WITH " + _ols("true_load", "hour") + """
SELECT zone, strftime(date, '%Y-%m-%d') AS target_day, hour, ROUND(a * t.pred + b, 3) AS pred FROM tagged t JOIN fit USING (hour) WHERE split = 'test'""")
def ml_linear_hourly(spark, d):
    """24 linear models on the baseline: ordinary least squares per hour."""
    rows, routes = _rows(spark, d), ML.hour_routes()
    models = ML.fit_routes(rows, ["base"], routes, _plain)
    out = ML.predict_routes(rows.where("split = 'test'"), models, routes, "linear")
    return out.select("zone", day(), "hour", rnd("pred", 3).alias("pred"))


@query("ml_residual_hourly", "WITH " + _ols("(true_load - lab_pred)", "hour").replace("lab_pred", "pred") + """
SELECT zone, strftime(date, '%Y-%m-%d') AS target_day, ROUND(AVG(ABS(t.pred + a * t.pred + b - true_load)), 3) AS mae
FROM tagged t JOIN fit USING (hour) WHERE split = 'test' GROUP BY ALL""")
def ml_residual_hourly(spark, d):
    """The same model on the residual target, with the baseline added back."""
    rows, routes = _rows(spark, d, residual=True), ML.hour_routes()
    models = ML.fit_routes(rows, ["base"], routes, _plain)
    test = rows.where("split = 'test'")
    pred = ML.gather(ML.predict_routes(test, models, routes, "residual"), test, residual=True)
    e = M.error_rows(pred)
    return e.groupBy("zone", F.col("date").cast("string").alias("target_day")).agg(
        rnd(F.avg("abs_error"), 3).alias("mae"))


@query("ml_routed_experts", "WITH " + _ols("true_load", "expert") + """
SELECT zone, strftime(date, '%Y-%m-%d') AS target_day, hour, 'shoulder__' || expert AS route, ROUND(a * t.pred + b, 3) AS pred
FROM tagged t JOIN fit USING (expert) WHERE split = 'test'""")
def ml_routed_experts(spark, d):
    """One model per (season, expert); seasons without rows have no model."""
    rows, routes = ML.tag_regime(_rows(spark, d)), ML.regime_routes(spark)
    models = ML.fit_routes(rows, ["base"], routes, _plain)
    out = ML.predict_routes(rows.where("split = 'test'"), models, routes, "routed")
    return out.select("zone", day(), "hour", "route", rnd("pred", 3).alias("pred"))


@query("ml_single_expert", "WITH " + _ols("true_load", "expert") + """
SELECT zone, ROUND(AVG(ABS(a * t.pred + b - true_load)), 3) AS mae, COUNT(*) AS n
FROM tagged t JOIN fit USING (expert) WHERE split = 'test' AND expert = 'peak' GROUP BY 1""")
def ml_single_expert(spark, d):
    """One season's peak expert alone, fitted and scored on its own hours."""
    rows = ML.tag_regime(_rows(spark, d)).where("season = 'shoulder' AND expert = 'peak'")
    routes = {"shoulder__peak": F.lit(True)}
    models = ML.fit_routes(rows, ["base"], routes, _plain)
    out = ML.predict_routes(rows.where("split = 'test'"), models, routes, "single").join(
        rows.select("zone", "target_day", "hour", "y"), ["zone", "target_day", "hour"])
    return out.groupBy("zone").agg(rnd(F.avg(F.abs(F.col("pred") - F.col("y"))), 3).alias("mae"),
                                   F.count(F.lit(1)).alias("n"))


def _summary(pred):
    return M.basic_scores(M.error_rows(pred)).select("zone", "model", r6("mape"), r6("mae"), r6("me"), "n_hours")


def _fit(spark, d, name, regressor, **kw):
    return fit_model(samples_of(spark, d), list(CFG.seq_cols), name, regressor, test_frac=0.3, embargo=3, **kw)


@query("ml_boosted_hourly")
def ml_boosted_hourly(spark, d):
    """24 boosted-tree models on the whole feature set."""
    return _summary(predict(_fit(spark, d, "gbt", ML.boosted_trees)))


@query("ml_boosted_residual_routed")
def ml_boosted_residual_routed(spark, d):
    """Boosted trees on the residual, one model per regime route."""
    return _summary(predict(_fit(spark, d, "gbt_residual", ML.boosted_trees, residual=True, routed=True)))


@query("ml_huber_routed")
def ml_huber_routed(spark, d):
    return _summary(predict(_fit(spark, d, "huber", lambda: ML.make_regressor("huber", maxIter=20), routed=True)))


@query("ml_l1_early_stop")
def ml_l1_early_stop(spark, d):
    """Absolute loss with a validation share that stops the boosting."""
    f = _fit(spark, d, "l1", lambda: ML.make_regressor("l1", validation=True), routed=True,
             val_frac=0.3, validation=True)
    return _summary(predict(f))


@query("ml_importance")
def ml_importance(spark, d):
    """Importance summed over the models of every route, by family and by lag position."""
    from hourcast.operators.diagnostics import sum_importance, top_columns
    f = _fit(spark, d, "gbt_importance", ML.boosted_trees, routed=True)
    names = ML.feature_names(f.features, CFG.seq_cols, CFG.lookback)
    return top_columns(sum_importance(ML.importance_rows(spark, f.models, names)), 30)


@query("regime_map_counts", "WITH " + ERRORS + """
SELECT zone, 'shoulder' AS season, CASE WHEN hour <= 4 THEN 'low' WHEN hour IN (6, 7, 8, 9, 17, 18, 19, 20) THEN 'peak' ELSE 'high' END AS expert,
  hour, COUNT(*) AS n FROM errors GROUP BY ALL""")
def regime_map_counts(spark, d):
    from hourcast.operators.regimes import add_regime
    return add_regime(errors(spark, d), day="date").groupBy("zone", "season", "expert", "hour").agg(F.count(F.lit(1)).alias("n"))


@query("regime_slice", "WITH " + HOURLY + """
SELECT zone, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, ROUND(load, 6) AS load FROM hourly
WHERE hr IN (6, 7, 8, 9, 17, 18, 19, 20) AND month(lt) NOT IN (12, 1, 2)""")
def regime_slice_query(spark, d):
    from .q_clean import keyed
    return keyed(regime_slice(hourly(spark, d), "shoulder", "peak"), r6("load"))


@query("regime_orders", """
WITH m AS (SELECT o_orderpriority AS zone, CASE WHEN month(o_orderdate) IN (7, 8) THEN 'summer' WHEN month(o_orderdate) IN (6, 9) THEN 'upper_shoulder'
    WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' ELSE 'shoulder' END AS season, o_orderkey % 24 AS hour FROM orders),
x AS (SELECT zone, season, CASE
  WHEN season = 'summer' THEN CASE WHEN hour BETWEEN 1 AND 6 THEN 'low' WHEN hour BETWEEN 12 AND 20 THEN 'peak' ELSE 'high' END
  WHEN season = 'upper_shoulder' THEN CASE WHEN hour BETWEEN 1 AND 6 THEN 'low' WHEN hour BETWEEN 14 AND 19 THEN 'peak' ELSE 'high' END
  WHEN season = 'shoulder' THEN CASE WHEN hour <= 4 THEN 'low' WHEN hour BETWEEN 6 AND 9 OR hour BETWEEN 17 AND 20 THEN 'peak' ELSE 'high' END
  ELSE CASE WHEN hour <= 4 THEN 'low' WHEN hour BETWEEN 6 AND 9 OR hour BETWEEN 17 AND 21 THEN 'peak' ELSE 'high' END END AS expert FROM m)
SELECT zone, season, expert, COUNT(*) AS n FROM x GROUP BY ALL""")
def regime_orders(spark, d):
    """All four seasons: order days with the key as a stand-in hour."""
    from .views import table
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("zone"), F.month("o_orderdate").alias("month"),
                                         (F.col("o_orderkey") % 24).cast("int").alias("hour"))
    # The map has 288 rows whatever the data.
    return o.join(F.broadcast(regime_map(spark)), ["month", "hour"]).groupBy("zone", "season", "expert").agg(
        F.count(F.lit(1)).alias("n"))
