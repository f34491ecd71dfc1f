"""Diagnostics queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.operators import diagnostics as D, samples as S
from hourcast.operators.correlation import correlations
from hourcast.schema import CALENDAR_NAMES
from hourcast.sources.forecasts import clean_forecast
from hourcast.sources.tables import stage

from .q_sample import CALENDAR, DAY, cleaned, day, usable
from .registry import query, rnd
from .views import (ERRORS, FORECAST, HOURLY, TARGETS, errors, forecast, hourly, index_sql,
                    r6, ts_text)

VALUES = HOURLY + index_sql() + TARGETS + CALENDAR + """,
wm AS (SELECT i.zone, i.target_day, AVG(h.load_est) AS a, AVG(h.t) AS b FROM idx i JOIN hourly h ON h.zone = i.zone
  AND h.p < i.cutoff AND h.p >= i.cutoff - 48 GROUP BY 1, 2),
fv AS (SELECT zone, target_day, unnest(['load_est', 'temp_f']) AS name, unnest([a, b]) AS value FROM wm
  UNION ALL SELECT i.zone, i.target_day, unnest(['tmrw_month_sin', 'tmrw_month_cos', 'tmrw_dow_sin', 'tmrw_dow_cos', 'tmrw_is_weekend', 'tmrw_is_holiday']),
    unnest(c.v) FROM idx i JOIN cal c ON c.zone = i.zone AND c.d = i.target_day),
tv AS (SELECT zone, d AS target_day, AVG(y) AS load, MAX(CASE WHEN slot = 15 THEN y END) AS load15 FROM tgt GROUP BY 1, 2),
live AS (SELECT zone, name FROM fv JOIN tv USING (zone, target_day) GROUP BY 1, 2 HAVING MIN(value) <> MAX(value)),
xy AS (SELECT * FROM fv JOIN tv USING (zone, target_day) JOIN live USING (zone, name))"""


def light(spark, d):
    """Window, calendar and target of each sample, without the static blocks."""
    h = cleaned(spark, d)
    index = usable(h)
    return (S.assemble_windows(h, index, ["load_est", "Temp_F"], 48, "clock")
            .join(S.target_calendar(h, "clock"), ["zone", "target_day"])
            .join(S.day_targets(h, "load", "clock").where("y IS NOT NULL"), ["zone", "target_day"]))


def _values(spark, d):
    """Features by name, and the samples they came from: written once, without the windows."""
    s = stage(D.with_features(light(spark, d), SEQ).select("zone", "target_day", "features", "y"), "features")
    return D.feature_values(s, SEQ), s


def tidy(df, digits=4):
    cols = [c for c in ("r", "slope", "intercept") if c in df.columns]
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.coalesce(rnd(c, digits), F.lit(-9.0)).alias(c) for c in cols])


_REL = """SELECT {by}, name, COALESCE(ROUND(corr({x}, {y}), 4) + 0.0, -9.0) AS r,
  COALESCE(ROUND(regr_slope({y}, {x}), 4) + 0.0, -9.0) AS slope, COALESCE(ROUND(regr_intercept({y}, {x}), 4) + 0.0, -9.0) AS intercept, COUNT(*) AS n
FROM xy GROUP BY ALL"""


def _live(values):
    """Without the features of a zone that never vary: they have no correlation, only rounding noise."""
    return values.join(D.dead_features(values).select("zone", "name"), ["zone", "name"], "left_anti")


def _relations(spark, d, hour=None, power=1):
    """The target rides along with the features, so the values are shuffled once, by zone and name."""
    _, s = _values(spark, d)
    return D.feature_relations(_live(D.feature_values(D.with_target(s, hour), SEQ, ["load"])), power=power)


@query("diag_feature_values", "WITH " + VALUES + f"SELECT zone, {DAY}, name, ROUND(value, 5) + 0.0 AS value FROM fv JOIN tv USING (zone, target_day)")
def diag_feature_values(spark, d):
    v, _ = _values(spark, d)
    return v.select("zone", day(), "name", rnd("value", 5).alias("value"))


@query("diag_relations", "WITH " + VALUES + _REL.format(by="zone", x="value", y="load"))
def diag_relations(spark, d):
    return tidy(_relations(spark, d))


@query("diag_relations_hour", "WITH " + VALUES + _REL.format(by="zone", x="value", y="load15"))
def diag_relations_hour(spark, d):
    """Against one target hour instead of the daily mean."""
    return tidy(_relations(spark, d, hour=15))


@query("diag_relations_squared", "WITH " + VALUES + _REL.format(by="zone", x="value * value", y="load"))
def diag_relations_squared(spark, d):
    return tidy(_relations(spark, d, power=2))


@query("diag_season_relations", "WITH " + VALUES + """
SELECT zone, 'shoulder' AS season, name, COALESCE(ROUND(corr(value, load), 4) + 0.0, -9.0) AS r, COUNT(*) AS n
FROM xy GROUP BY ALL""")
def diag_season_relations(spark, d):
    v, s = _values(spark, d)
    return tidy(D.season_relations(_live(v), D.target_value(s)))


@query("diag_dead_features", "WITH " + VALUES + """
SELECT zone, name, ROUND(MIN(value), 6) + 0.0 AS value FROM fv JOIN tv USING (zone, target_day) GROUP BY 1, 2 HAVING MIN(value) = MAX(value)""")
def diag_dead_features(spark, d):
    v, _ = _values(spark, d)
    return D.dead_features(v).select("zone", "name", r6("value"))


@query("diag_correlation_matrix", "WITH " + VALUES + """,
w AS (SELECT zone, target_day, name, value FROM xy UNION ALL SELECT zone, target_day, 'load', load FROM tv
      WHERE EXISTS (SELECT 1 FROM idx i WHERE i.zone = tv.zone AND i.target_day = tv.target_day))
SELECT x.zone, x.name AS a, y.name AS b, COALESCE(ROUND(corr(x.value, y.value), 4) + 0.0, -9.0) AS r
FROM w x JOIN w y USING (zone, target_day) GROUP BY ALL""")
def diag_correlation_matrix(spark, d):
    v, s = _values(spark, d)
    target = D.target_value(s).select("zone", "target_day", F.lit("load").alias("name"), F.col("load").alias("value"))
    names = ["load_est", "temp_f", *CALENDAR_NAMES, "load"]
    out = D.correlation_matrix(_live(v).unionByName(target), names)
    # A feature that a zone lacks leaves no row in the twin.
    return tidy(out.join(D.dead_features(v).select("zone", F.col("name").alias("a")), ["zone", "a"], "left_anti")
                .join(D.dead_features(v).select("zone", F.col("name").alias("b")), ["zone", "b"], "left_anti"))


@query("diag_common_keys", "WITH " + VALUES + f"""
SELECT i.zone, {DAY}, ROUND(load, 5) AS load FROM idx i JOIN tv USING (zone, target_day)""")
def diag_common_keys(spark, d):
    h = hourly(spark, d)
    y = D.target_value(S.day_targets(h, "load", "clock").where("y IS NOT NULL"))
    return D.common_keys(usable(h), y).select("zone", day(), rnd("load", 5).alias("load"))


@query("diag_tail_hours", "WITH " + ERRORS + """,
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY signed_error, datetime) AS u, COUNT(*) OVER (PARTITION BY zone) AS n FROM errors),
k AS (SELECT *, GREATEST(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS k FROM r),
a AS (SELECT zone, hour, COUNT(*) AS c FROM errors GROUP BY 1, 2),
t AS (SELECT zone, model, 'over' AS tail, hour, n, k FROM k WHERE u > n - k UNION ALL SELECT zone, model, 'under', hour, n, k FROM k WHERE u <= k)
SELECT t.zone, model, tail, t.hour, COUNT(*) AS n, ROUND(COUNT(*) / ANY_VALUE(k)::DOUBLE, 6) AS share,
  ROUND(ANY_VALUE(a.c) / ANY_VALUE(t.n)::DOUBLE, 6) AS base_share,
  ROUND((COUNT(*) / ANY_VALUE(k)::DOUBLE) / (ANY_VALUE(a.c) / ANY_VALUE(t.n)::DOUBLE), 5) AS lift
FROM t JOIN a ON a.zone = t.zone AND a.hour = t.hour GROUP BY t.zone, model, tail, t.hour""")
def diag_tail_hours(spark, d):
    t = D.tail_error_hours(errors(spark, d))
    return t.select("zone", "model", "tail", "hour", F.col("n").cast("bigint").alias("n"), r6("share"), r6("base_share"),
                    rnd("lift", 5).alias("lift"))


@query("diag_estimate_quality", "WITH " + HOURLY + """
SELECT zone, COUNT(*) AS n, ROUND(AVG(load_est - load), 6) + 0.0 AS mean_error, ROUND(stddev_samp(load_est - load), 6) AS std_error,
  ROUND(AVG(ABS(load_est - load)), 6) AS mae, ROUND(AVG(ABS(load_est - load) / load) * 100, 6) AS mape,
  ROUND(MIN(load_est - load), 6) + 0.0 AS min_error, ROUND(MAX(load_est - load), 6) + 0.0 AS max_error FROM hourly GROUP BY 1""")
def diag_estimate_quality(spark, d):
    q = D.estimate_quality(hourly(spark, d))
    return q.select("zone", "n", *[r6(c) for c in ("mean_error", "std_error", "mae", "mape", "min_error", "max_error")])


@query("diag_estimate_trend", "WITH " + HOURLY + """
SELECT zone, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, ROUND(AVG(load_est - load) OVER w, 5) + 0.0 AS trend,
  ROUND(AVG(ABS(load_est - load)) OVER w, 5) AS abs_trend FROM hourly
WINDOW w AS (PARTITION BY zone ORDER BY lt RANGE BETWEEN INTERVAL '604799999999 microseconds' PRECEDING AND CURRENT ROW)""")
def diag_estimate_trend(spark, d):
    t = D.estimate_trend(hourly(spark, d))
    return t.select("zone", ts_text("ts_utc").alias("ts_utc"), *[rnd(c, 5).alias(c) for c in ("trend", "abs_trend")])


@query("diag_month_stats", """
SELECT o_orderpriority AS zone, month(o_orderdate) AS month, ROUND(AVG(o_totalprice), 2) AS mean, ROUND(var_samp(o_totalprice) / 1e6, 3) AS var,
  ROUND(stddev_samp(o_totalprice), 2) AS std, COUNT(*) AS count FROM orders GROUP BY 1, 2""")
def diag_month_stats(spark, d):
    from .views import table
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("zone"), F.col("o_orderdate").alias("ts_local"),
                                         F.col("o_totalprice").alias("load"))
    m = D.month_stats(o)
    return m.select("zone", "month", rnd("mean", 2).alias("mean"), rnd(F.col("var") / 1e6, 3).alias("var"),
                    rnd("std", 2).alias("std"), "count")


for _stat, _fn in (("mean", "AVG"), ("var", "var_samp")):
    @query(f"diag_month_hour_{_stat}", "WITH " + HOURLY + "SELECT zone, month(lt) AS month, " + ", ".join(
        f"COALESCE(ROUND({_fn}(CASE WHEN hr = {h} THEN load END), 4), -1.0) AS h{h}" for h in range(24)) + " FROM hourly GROUP BY 1, 2")
    def diag_month_hour(spark, d, stat=_stat):
        t = D.month_hour_stats(hourly(spark, d), stat=stat)
        return t.select("zone", "month", *[F.coalesce(rnd(f"h{h}", 4), F.lit(-1.0)).alias(f"h{h}") for h in range(24)])


@query("diag_forecast_skill", "WITH " + FORECAST + """,
o AS (SELECT zone, lt, MIN(t) AS t FROM hourly GROUP BY 1, 2)
SELECT f.zone, lead_day, ROUND(SQRT(AVG((f.t - o.t) * (f.t - o.t))), 6) AS rmse, ROUND(AVG(f.t - o.t), 6) AS bias, COUNT(*) AS n
FROM fc f JOIN o ON o.zone = f.zone AND o.lt = f.valid_local WHERE f.t IS NOT NULL GROUP BY 1, 2""")
def diag_forecast_skill(spark, d):
    s = D.forecast_skill(clean_forecast(forecast(spark, d)), hourly(spark, d))
    return s.select("zone", "lead_day", r6("rmse"), r6("bias"), "n")


@query("diag_parity", "WITH " + HOURLY + """
SELECT zone, CASE WHEN h % 101 = 3 THEN 'only_left' ELSE 'differs' END AS issue, COUNT(*) AS n FROM hourly
WHERE h % 101 = 3 OR h % 103 = 4 GROUP BY ALL""")
def diag_parity(spark, d):
    """A copy with every 101st hour missing and every 103rd one off by one."""
    h = hourly(spark, d).select("zone", "ts_utc", "h", "load", "load_est")
    other = h.where("h % 101 <> 3").withColumn("load", F.when(F.col("h") % 103 == 4, F.col("load") + 1).otherwise(F.col("load")))
    return D.parity(h, other, ["zone", "ts_utc"], ["load", "load_est"]).groupBy("zone", "issue").agg(F.count(F.lit(1)).alias("n"))


# ---- importance: |correlation| of each flattened column with the daily mean -----------------

IMP = HOURLY + index_sql() + TARGETS + CALENDAR + """,
tv AS (SELECT zone, d AS target_day, AVG(y) AS load FROM tgt GROUP BY 1, 2),
fl AS (SELECT i.zone, i.target_day, unnest(['load_est_h', 'temp_f_h']) || CAST(48 - (i.cutoff - h.p) AS VARCHAR) AS name,
    unnest([h.load_est, h.t]) AS value FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 48
  UNION ALL SELECT i.zone, i.target_day, unnest(['tmrw_dow_sin', 'tmrw_dow_cos', 'fc_dev_h7']), unnest([c.v[3], c.v[4], c.v[5]])
  FROM idx i JOIN cal c ON c.zone = i.zone AND c.d = i.target_day),
im AS (SELECT name, ABS(corr(value, load)) AS importance FROM fl JOIN tv USING (zone, target_day) GROUP BY 1),
parts AS (SELECT *, CASE WHEN name LIKE 'load_est_h%' THEN 'load_est' WHEN name LIKE 'temp_f_h%' THEN 'temp_f' ELSE name END AS family,
  CASE WHEN name LIKE 'load_est_h%' OR name LIKE 'temp_f_h%' THEN CAST(regexp_extract(name, '_h(\\d+)$', 1) AS INTEGER) END AS lag FROM im)"""
SEQ = ["load_est", "Temp_F"]


def importance(spark, d):
    """A hundred numbers, written once: their sum and their shares read them again."""
    scalars = {n: F.col("calendar")[i] for n, i in (("tmrw_dow_sin", 2), ("tmrw_dow_cos", 3), ("fc_dev_h7", 4))}
    long = S.flatten_windows(D.with_target(light(spark, d)), SEQ, scalars, ["load"])
    rel = D.feature_relations(long, by=())
    return stage(rel.select("name", F.abs("r").alias("importance")), "importance")


@query("diag_importance_family", "WITH " + IMP + """
SELECT family, ROUND(SUM(importance), 4) AS importance, COUNT(*) AS n_cols, ROUND(100 * SUM(importance) / (SELECT SUM(importance) FROM im), 4) AS pct
FROM parts GROUP BY 1""")
def diag_importance_family(spark, d):
    """A static name that merely looks like a lag stays whole."""
    f = D.importance_by_family(importance(spark, d), SEQ)
    return f.select("family", rnd("importance", 4).alias("importance"), "n_cols", rnd("pct", 4).alias("pct"))


@query("diag_importance_static", "WITH " + IMP + """
SELECT name, ROUND(importance, 4) AS importance, ROUND(100 * importance / (SELECT SUM(importance) FROM im), 4) AS pct FROM parts WHERE lag IS NULL""")
def diag_importance_static(spark, d):
    f = D.static_importance(importance(spark, d), SEQ)
    return f.select("name", rnd("importance", 4).alias("importance"), rnd("pct", 4).alias("pct"))


@query("diag_importance_lag", "WITH " + IMP + "SELECT lag, ROUND(SUM(importance), 4) AS importance FROM parts WHERE lag IS NOT NULL GROUP BY 1")
def diag_importance_lag(spark, d):
    f = D.importance_by_lag(importance(spark, d), SEQ)
    return f.select("lag", rnd("importance", 4).alias("importance"))


@query("diag_importance_top", "WITH " + IMP + "SELECT name, ROUND(importance, 4) AS importance FROM im ORDER BY im.importance DESC, name LIMIT 10")
def diag_importance_top(spark, d):
    f = D.top_columns(importance(spark, d), 10)
    return f.select("name", rnd("importance", 4).alias("importance"))




@query("diag_correlation_blocks", "WITH " + HOURLY + """,
v AS (SELECT zone, ld, name, AVG(x) AS x FROM (
  SELECT zone, ld, 'load_' || hr AS name, load AS x FROM hourly UNION ALL SELECT zone, ld, 'est_' || hr, load_est FROM hourly
  UNION ALL SELECT zone, ld, 'temp_' || hr, t FROM hourly) GROUP BY ALL)
SELECT least(x.name, y.name) AS a, greatest(x.name, y.name) AS b, COUNT(*) AS n, ROUND(corr(x.x, y.x), 6) + 0.0 AS r
FROM v x JOIN v y ON x.zone = y.zone AND x.ld = y.ld AND x.name <= y.name GROUP BY ALL""")
def diag_correlation_blocks(spark, d):
    """All 72 x 72 / 2 correlations between the hours of load, estimate and temperature, over the days of all zones."""
    h = hourly(spark, d).withColumns({"day": F.to_date("ts_local"), "hour": F.hour("ts_local")})
    kinds = {"load": "load", "est": "load_est", "temp": "Temp_F"}
    wide = h.groupBy("zone", "day").agg(*[F.avg(F.when(F.col("hour") == k, F.col(c))).alias(f"{n}_{k}")
                                          for n, c in kinds.items() for k in range(24)])
    out = correlations(wide, sorted(f"{n}_{k}" for n in kinds for k in range(24)), block=32)
    return out.select("a", "b", "n", (rnd("r", 6) + 0.0).alias("r"))
