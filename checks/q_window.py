"""Thermal, rolling, streak, climatology and scaling queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.functions import cooling, heat_index, heating, wet_bulb
from hourcast.operators import rolling as R, samples as S, scaling as C
from hourcast.operators.chunks import rank_position
from hourcast.operators.quantiles import quantiles

from .q_clean import TS, keyed
from .registry import query, rnd
from .views import (DAILY, ERRORS, HOURLY, SPARSE, daily, errors, hourly, hourly_sparse, r6, ts_text)

PHYSICS = """,
ph AS (SELECT *, GREATEST(0, t - 65) AS cdd, GREATEST(0, 65 - t) AS hdd,
  0.5 * (t + 61.0 + (t - 68.0) * 1.2 + rh * 0.094) AS mild, (t - 32.0) * 5.0 / 9.0 AS tc FROM {src}),
ph2 AS (SELECT *,
  CASE WHEN (mild + t) / 2 >= 80 THEN -42.379 + 2.04901523*t + 10.14333127*rh - 0.22475541*t*rh - 6.83783e-3*t*t
    - 5.481717e-2*rh*rh + 1.22874e-3*t*t*rh + 8.5282e-4*t*rh*rh - 1.99e-6*t*t*rh*rh ELSE mild END AS hi_f,
  (tc*atan(0.151977*sqrt(rh+8.313659)) + atan(tc+rh) - atan(rh-1.676331) + 0.00391838*pow(rh,1.5)*atan(0.023101*rh) - 4.686035)*9.0/5.0+32.0 AS wb
  FROM ph)"""


@query("thermal_physics", "WITH " + HOURLY + PHYSICS.format(src="hourly") + f"""
SELECT zone, {TS}, ROUND(cdd, 6) AS cdd, ROUND(hdd, 6) AS hdd, ROUND(hi_f, 6) AS heat_index, ROUND(wb, 6) AS wet_bulb FROM ph2""")
def thermal_physics(spark, d):
    t, rh = F.col("Temp_F"), F.col("RelativeHumidity_pct")
    return keyed(hourly(spark, d), r6(cooling(t), "cdd"), r6(heating(t), "hdd"),
                 r6(heat_index(t, rh), "heat_index"), r6(wet_bulb(t, rh), "wet_bulb"))


THERMAL_SEQ = PHYSICS + f"""
SELECT zone, {TS},
  ROUND(SUM(cdd) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS cdd24,
  ROUND(SUM(cdd) OVER (w ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), 6) AS cdd48,
  ROUND(SUM(cdd) OVER (w ROWS BETWEEN 71 PRECEDING AND CURRENT ROW), 6) AS cdd72,
  ROUND(AVG(t) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS ma24,
  ROUND(AVG(t) OVER (w ROWS BETWEEN 71 PRECEDING AND CURRENT ROW), 6) AS ma72,
  COALESCE(ROUND(t - LAG(t, 24) OVER w, 6), 0.0) AS delta24, ROUND(hi_f, 6) AS heat_index, ROUND(wb, 6) AS wet_bulb
FROM ph2 WINDOW w AS (PARTITION BY zone ORDER BY ts_utc)"""


def _seq(df, **kw):
    out = R.add_thermal_sequence(df, **kw)
    return keyed(out, r6("CDD_cum_24h", "cdd24"), r6("CDD_cum_48h", "cdd48"), r6("CDD_cum_72h", "cdd72"),
                 r6("Temp_ma_24h", "ma24"), r6("Temp_ma_72h", "ma72"), r6("Temp_delta_24h", "delta24"),
                 r6("HeatIndex_F", "heat_index"), r6("WetBulb_F", "wet_bulb"))


@query("thermal_sequence", "WITH " + HOURLY + THERMAL_SEQ.format(src="hourly"))
def thermal_sequence(spark, d):
    return _seq(hourly(spark, d), position="clock")


@query("thermal_sequence_sparse", "WITH " + SPARSE + THERMAL_SEQ.format(src="sparse"))
def thermal_sequence_sparse(spark, d):
    """Row frames over a series with holes: positions are ranks."""
    return _seq(hourly_sparse(spark, d))


@query("roll_rank_position", "WITH " + SPARSE + f"""
SELECT zone, {TS}, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY ts_utc) - 1 AS pos FROM sparse""")
def roll_rank_position(spark, d):
    return keyed(rank_position(hourly_sparse(spark, d), size=100), "pos")


@query("roll_time_mean", "WITH " + ERRORS + """
SELECT zone, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime,
  ROUND(AVG(signed_error) OVER w, 5) + 0.0 AS trend, ROUND(AVG(abs_error) OVER w, 5) AS abs_trend
FROM errors WINDOW w AS (PARTITION BY zone ORDER BY datetime RANGE BETWEEN INTERVAL '604799999999 microseconds' PRECEDING AND CURRENT ROW)""")
def roll_time_mean(spark, d):
    e = errors(spark, d).withColumn("at", F.col("datetime").cast("timestamp"))
    out = R.rolling_time_mean(e, {"trend": F.col("signed_error"), "abs_trend": F.col("abs_error")}, 7, "at")
    return out.select("zone", ts_text("datetime").alias("datetime"),
                      *[rnd(c, 5).alias(c) for c in ("trend", "abs_trend")])


@query("roll_group_departure", "WITH " + HOURLY + f"""
SELECT zone, {TS}, ROUND(load - AVG(load) OVER (PARTITION BY zone, hr), 5) AS departure FROM hourly""")
def roll_group_departure(spark, d):
    h = hourly(spark, d).withColumn("hour", F.hour("ts_local"))
    return keyed(R.group_departure(h, "load", ["zone", "hour"]), rnd("departure", 5).alias("departure"))


@query("roll_daily_temperature", "WITH " + HOURLY + """
SELECT zone, strftime(ld, '%Y-%m-%d') AS local_date, ROUND(AVG(t), 6) AS temp_mean, bool_or(h < 300) AS is_train
FROM hourly GROUP BY zone, ld""")
def roll_daily_temperature(spark, d):
    out = R.daily_temperature(hourly(spark, d), train=F.col("h") < 300)
    return out.select("zone", F.col("local_date").cast("string").alias("local_date"), r6("temp_mean"), "is_train")


@query("streak", "WITH " + DAILY + """,
hot AS (SELECT zone, local_date, COALESCE(CAST(temp_mean >= 60 AS INTEGER), 0) AS hot FROM daily),
run AS (SELECT *, SUM(1 - hot) OVER (PARTITION BY zone ORDER BY local_date) AS r FROM hot)
SELECT zone, strftime(local_date, '%Y-%m-%d') AS local_date,
  CAST(SUM(hot) OVER (PARTITION BY zone, r ORDER BY local_date) AS BIGINT) AS streak FROM run""")
def streak(spark, d):
    days = daily(spark, d)
    limit = days.select("zone").distinct().withColumn("threshold", F.lit(60.0))
    return R.heat_streak(days, limit).select(
        "zone", F.col("local_date").cast("string").alias("local_date"), "streak")


@query("heat_threshold", "WITH " + DAILY + """
SELECT zone, ROUND(COALESCE(quantile_cont(CASE WHEN is_train AND month(local_date) IN (6, 7, 8) THEN temp_mean END, 0.75), 75.0), 6) AS threshold
FROM daily GROUP BY 1""")
def heat_threshold(spark, d):
    return S.fit_heat_threshold(daily(spark, d)).select("zone", r6("threshold"))


@query("climatology", "WITH " + DAILY + """,
tr AS (SELECT zone, dayofyear(local_date) AS d, temp_mean AS t FROM daily WHERE is_train AND temp_mean IS NOT NULL),
grid AS (SELECT zone, unnest(range(1, 367)) AS doy FROM (SELECT DISTINCT zone FROM tr)),
gm AS (SELECT zone, AVG(t) AS m FROM tr GROUP BY 1),
cl AS (SELECT g.zone, g.doy, AVG(tr.t) AS c FROM grid g JOIN tr ON tr.zone = g.zone
  AND LEAST(ABS(tr.d - g.doy), 366 - ABS(tr.d - g.doy)) <= 7 GROUP BY 1, 2)
SELECT g.zone, g.doy, ROUND(COALESCE(c, m), 6) AS clim FROM grid g JOIN gm USING (zone) LEFT JOIN cl ON cl.zone = g.zone AND cl.doy = g.doy""")
def climatology(spark, d):
    rows = daily(spark, d).select("zone", F.col("local_date").cast("timestamp_ntz").alias("ts_local"),
                                  F.col("temp_mean").alias("Temp_F"), "is_train")
    return S.fit_climatology(rows).select("zone", "doy", r6("clim"))


@query("climatology_hourly", "WITH " + HOURLY + """,
n AS (SELECT zone, MIN(p) + CAST(floor(COUNT(*) * 0.8) AS BIGINT) AS cut FROM hourly GROUP BY 1),
tr AS (SELECT h.zone, dayofyear(lt) AS d, t FROM hourly h JOIN n USING (zone) WHERE p < cut),
g366 AS (SELECT zone, unnest(range(1, 367)) AS doy FROM (SELECT DISTINCT zone FROM tr)),
gm AS (SELECT zone, AVG(t) AS m FROM tr GROUP BY 1),
sm AS (SELECT zone, d, SUM(t) AS s, COUNT(*) AS k FROM tr GROUP BY 1, 2),
cl AS (SELECT g.zone, g.doy, SUM(s) / SUM(k) AS c FROM g366 g JOIN sm ON sm.zone = g.zone
  AND LEAST(ABS(sm.d - g.doy), 366 - ABS(sm.d - g.doy)) <= 7 GROUP BY 1, 2)
SELECT g.zone, g.doy, ROUND(COALESCE(c, m), 6) AS clim FROM g366 g JOIN gm USING (zone) LEFT JOIN cl ON cl.zone = g.zone AND cl.doy = g.doy""")
def climatology_hourly(spark, d):
    refs = S.fit_thermal_refs(hourly(spark, d), 0.2, position="clock")
    return refs.climatology.select("zone", "doy", r6("clim"))


@query("train_mask", "WITH " + HOURLY + f""",
n AS (SELECT zone, COUNT(*) AS n FROM hourly GROUP BY 1)
SELECT zone, {TS}, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY ts_utc) - 1 < floor(n * 0.8) AS is_train FROM hourly JOIN n USING (zone)""")
def train_mask(spark, d):
    return keyed(S.mark_train(hourly(spark, d), 0.2, "clock"), "is_train")


@query("quantiles_exact", """
SELECT o_orderpriority AS zone, ROUND(quantile_cont(o_totalprice, 0.05), 6) AS p05, ROUND(quantile_cont(o_totalprice, 0.25), 6) AS p25,
  ROUND(quantile_cont(o_totalprice, 0.5), 6) AS p50, ROUND(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders GROUP BY 1""")
def quantiles_exact(spark, d):
    from .views import table
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("zone"), "o_totalprice")
    q = quantiles(o, ["zone"], "o_totalprice", [0.05, 0.25, 0.5, 0.99])
    return q.select("zone", *[r6(F.col("q")[i], n) for i, n in enumerate(["p05", "p25", "p50", "p99"])])


SCALER = """,
n AS (SELECT zone, MIN(p) + CAST(floor(COUNT(*) * 0.8) AS BIGINT) AS cut FROM hourly GROUP BY 1),
sc AS (SELECT zone, AVG(load_est) AS ml, stddev_pop(load_est) AS sl, AVG(t) AS mt, stddev_pop(t) AS st
       FROM hourly JOIN n USING (zone) WHERE p < cut GROUP BY 1)"""


def _scaler(h):
    marked = S.mark_train(h, 0.2, "clock")
    return C.fit_scaler(marked, ["load_est", "Temp_F"], F.col("is_train"))


@query("scale_fit", "WITH " + HOURLY + SCALER + """
SELECT zone, 'load_est' AS feature, ROUND(ml, 5) AS mean, ROUND(sl, 5) AS scale FROM sc
UNION ALL SELECT zone, 'Temp_F', ROUND(mt, 5), ROUND(st, 5) FROM sc""")
def scale_fit(spark, d):
    return _scaler(hourly(spark, d)).select("zone", "feature", rnd("mean", 5).alias("mean"),
                                            rnd("scale", 5).alias("scale"))


@query("scale_apply_invert", "WITH " + HOURLY + SCALER + f"""
SELECT zone, {TS}, ROUND((load_est - ml) / sl, 5) + 0.0 AS load_scaled, ROUND((t - mt) / st, 5) + 0.0 AS temp_scaled,
  ROUND(load_est, 5) AS load_back FROM hourly JOIN sc USING (zone)""")
def scale_apply(spark, d):
    h = hourly(spark, d)
    scaler = _scaler(h)
    scaled = C.apply_scaler(h, scaler, ["load_est", "Temp_F"]).withColumn("load_back", F.col("load_est"))
    back = C.invert_scaler(scaled, scaler, "load_est", ["load_back"])
    return keyed(back, rnd("load_est", 5).alias("load_scaled"), rnd("Temp_F", 5).alias("temp_scaled"),
                 rnd("load_back", 5).alias("load_back"))


@query("scale_target", "WITH " + HOURLY + """,
n AS (SELECT zone, MIN(p) + CAST(floor(COUNT(*) * 0.8) AS BIGINT) AS cut FROM hourly GROUP BY 1)
SELECT zone, 'load' AS feature, ROUND(AVG(load), 5) AS mean, ROUND(stddev_pop(load), 5) AS scale
FROM hourly JOIN n USING (zone) WHERE p < cut GROUP BY 1""")
def scale_target(spark, d):
    s = C.fit_target_scaler(hourly(spark, d), 0.2, position="clock")
    return s.select("zone", "feature", rnd("mean", 5).alias("mean"), rnd("scale", 5).alias("scale"))


