"""Sample assembly and forecast-archive queries."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hourcast.operators import samples as S
from hourcast.operators.scaling import fit_static_scaler, scale_statics
from hourcast.plans.training import tensor
from hourcast.sources import forecasts as FC, tables as T, weather as WX

from .q_clean import HOLIDAYS
from .registry import query, rnd
from .views import (CFG, FORECAST, HOURLY, TARGETS, calendar_hourly, forecast, hourly, index_sql, r6, ts_text)

DAY = "strftime(target_day, '%Y-%m-%d') AS target_day"


def day(c="target_day"):
    return F.col(c).cast("string").alias(c)


def usable(h, cfg=CFG):
    return S.sample_index(h, cfg).where("status = 'ok'")


def exploded(df, col, digits=6):
    # Exploded by name, Spark asks beforehand whether the array has values, and works all of it out a second time for that.
    long = df.select("zone", "target_day", F.posexplode(F.transform(col, lambda v: rnd(v, digits))).alias("idx", "value"))
    return long.select("zone", day(), "idx", "value")


for _hour in (0, 9, 18):
    @query(f"sample_index_h{_hour}", "WITH " + HOURLY + index_sql(48, 72, _hour) + f"""
SELECT zone, {DAY}, status, COALESCE(cutoff - z0, -1) AS rows_before FROM idx_all""")
    def sample_index(spark, d, hour=_hour):
        out = S.sample_index(hourly(spark, d), replace(CFG, cutoff_hour=hour))
        before = F.coalesce(F.col("cutoff_pos") - F.col("zone_start"), F.lit(-1)).alias("rows_before")
        return out.select("zone", day(), "status", before)


@query("sample_lookback", "WITH " + HOURLY + index_sql() + f"""
SELECT i.zone, {DAY}, i.cutoff - h.p AS off, ROUND(h.load_est, 6) AS load_est
FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 48""")
def sample_lookback(spark, d):
    h = hourly(spark, d)
    out = S.lookback_join(h, usable(h), 48, "clock")
    return out.select("zone", day(), "off", r6("load_est"))


@query("sample_windows_flat", "WITH " + HOURLY + index_sql() + f"""
SELECT zone, target_day, name, value FROM (
  SELECT i.zone, {DAY}, unnest(['load_est_h', 'temp_f_h']) || CAST(48 - (i.cutoff - h.p) AS VARCHAR) AS name,
    unnest([ROUND(h.load_est, 6), ROUND(h.t, 6)]) AS value
  FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 48)""")
def sample_windows_flat(spark, d):
    h = hourly(spark, d)
    win = S.assemble_windows(h, usable(h), ["load_est", "Temp_F"], 48, "clock")
    return S.flatten_windows(win, ["load_est", "Temp_F"]).select("zone", day(), "name", r6("value"))


@query("sample_targets", "WITH " + HOURLY + TARGETS + """
SELECT zone, strftime(t.d, '%Y-%m-%d') AS target_day, slot AS idx, ROUND(y, 6) AS value, ok AS is_target_valid
FROM tgt t JOIN (SELECT zone, d, ok FROM tgt_n) USING (zone, d)""")
def sample_targets(spark, d):
    """23-, 24- and 25-hour days as 24 values."""
    y = S.day_targets(hourly(spark, d), "load", "clock").where("y IS NOT NULL")
    long = y.select("zone", "target_day", "is_target_valid", F.posexplode("y").alias("idx", "v"))
    return long.select("zone", day(), "idx", r6("v", "value"), "is_target_valid")


CALENDAR = f""",
fd AS (SELECT zone, ld, ROW_NUMBER() OVER (PARTITION BY zone, ld ORDER BY ts_utc) AS k, lt,
         MIN(lt) OVER (PARTITION BY zone) AS first_lt FROM hourly),
cal AS (SELECT zone, ld AS d, [sin(2*pi()*month(ld)/12), cos(2*pi()*month(ld)/12), sin(2*pi()*(isodow(ld)-1)/7),
  cos(2*pi()*(isodow(ld)-1)/7), CAST(isodow(ld) >= 6 AS DOUBLE),
  CAST(ld IN {HOLIDAYS} AND CAST(ld AS TIMESTAMP) >= first_lt AS DOUBLE)] AS v FROM fd WHERE k = 1)"""


@query("sample_calendar", "WITH " + HOURLY + CALENDAR + """
SELECT zone, strftime(d, '%Y-%m-%d') AS target_day, unnest(range(6)) AS idx, ROUND(unnest(v), 6) + 0.0 AS value FROM cal""")
def sample_calendar(spark, d):
    return exploded(S.target_calendar(calendar_hourly(spark, d), "clock"), "calendar")


MACRO = """,
mw AS (SELECT i.zone, i.target_day, i.cutoff - h.p AS off, h.hr, h.load_est AS x, g.load_est AS wk
  FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 72
  LEFT JOIN hourly g ON g.zone = h.zone AND g.p = h.p - 24),
mq AS (SELECT zone, target_day,
  quantile_cont(CASE WHEN off <= 24 AND hr BETWEEN 1 AND 6 THEN x END, 0.05) AS q1,
  quantile_cont(CASE WHEN off BETWEEN 25 AND 48 AND hr BETWEEN 1 AND 6 THEN x END, 0.05) AS q2,
  quantile_cont(CASE WHEN off BETWEEN 49 AND 72 AND hr BETWEEN 1 AND 6 THEN x END, 0.05) AS q3,
  SUM(CASE WHEN off <= 24 THEN x END) AS e1, SUM(CASE WHEN off BETWEEN 25 AND 48 THEN x END) AS e2,
  AVG(CASE WHEN off <= 6 THEN ABS(x - wk) END) AS le FROM mw GROUP BY 1, 2),
macro AS (SELECT zone, target_day, [q1 - q2, q2 - q3, CASE WHEN e2 = 0 THEN 1.0 ELSE e1 / e2 END, le] AS v FROM mq)"""


@query("sample_macro", "WITH " + HOURLY + index_sql() + MACRO + f"""
SELECT zone, {DAY}, unnest(range(4)) AS idx, ROUND(unnest(v), 6) + 0.0 AS value FROM macro""")
def sample_macro(spark, d):
    h = hourly(spark, d)
    return exploded(S.macro_features(h, usable(h), CFG.week, "clock"), "macro")


REFS = """,
tn AS (SELECT zone, MIN(p) + CAST(floor(COUNT(*) * 0.8) AS BIGINT) AS cut FROM hourly GROUP BY 1),
tr AS (SELECT h.zone, dayofyear(lt) AS d, t FROM hourly h JOIN tn USING (zone) WHERE p < cut),
sm AS (SELECT zone, d, SUM(t) AS s, COUNT(*) AS k FROM tr GROUP BY 1, 2),
gm AS (SELECT zone, SUM(s) / SUM(k) AS m FROM sm GROUP BY 1),
dm AS (SELECT zone, ld, AVG(t) AS m FROM hourly GROUP BY 1, 2),
hot AS (SELECT zone, ld, CAST(m >= {thr} AS INTEGER) AS hot FROM dm),
hrun AS (SELECT *, SUM(1 - hot) OVER (PARTITION BY zone ORDER BY ld) AS r FROM hot),
stk AS (SELECT zone, ld, SUM(hot) OVER (PARTITION BY zone, r ORDER BY ld) AS streak FROM hrun),
tw AS (SELECT i.zone, i.target_day, i.cutoff - h.p AS off, h.ld, dayofyear(h.lt) AS doy, h.t, GREATEST(0, h.t - 65) AS c
  FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 72),
ta AS (SELECT zone, target_day, MAX(CASE WHEN off = 1 THEN ld END) AS last_day, MAX(CASE WHEN off = 12 THEN doy END) AS doy,
  MAX(CASE WHEN off <= 24 THEN t END) AS mx1, SUM(CASE WHEN off <= 24 THEN c END) AS c1,
  SUM(CASE WHEN off BETWEEN 25 AND 48 THEN c END) AS c2, MAX(t) AS mx3,
  AVG(CASE WHEN off <= 24 THEN t END) AS a1, AVG(CASE WHEN off >= 49 THEN t END) AS a3 FROM tw GROUP BY 1, 2),
cl AS (SELECT zone, doy, SUM(s) / SUM(k) AS clim FROM (SELECT DISTINCT zone, doy FROM ta) q JOIN sm USING (zone)
  WHERE LEAST(ABS(sm.d - q.doy), 366 - ABS(sm.d - q.doy)) <= 7 GROUP BY 1, 2),
thermal AS (SELECT ta.zone, ta.target_day, [CAST(streak AS DOUBLE), mx1, c1, mx3, c1 / (c2 + 1e-3), a1 - a3, a1 - COALESCE(clim, gm.m)] AS v
  FROM ta JOIN stk ON stk.zone = ta.zone AND stk.ld = ta.last_day JOIN gm ON gm.zone = ta.zone
  LEFT JOIN cl ON cl.zone = ta.zone AND cl.doy = ta.doy)"""


@query("sample_thermal", "WITH " + HOURLY + index_sql() + REFS.format(thr=75) + f"""
SELECT zone, {DAY}, unnest(range(7)) AS idx, ROUND(unnest(v), 5) + 0.0 AS value FROM thermal""")
def sample_thermal(spark, d):
    """No summer day lies in the hourly view, so the threshold is the default of 75."""
    h = hourly(spark, d)
    refs = S.fit_thermal_refs(h, 0.2, position="clock")
    return exploded(S.thermal_static(h, usable(h), refs, "clock"), "thermal", 5)


# ---- forecast archive ----------------------------------------------------------------------

@query("fc_duplicates", "WITH " + FORECAST + """
SELECT zone, CAST(SUM(k - 1) AS BIGINT) AS n_duplicates FROM (
  SELECT zone, valid_local, lead_day, COUNT(*) AS k FROM fc0 GROUP BY ALL) GROUP BY 1""")
def fc_duplicates(spark, d):
    return FC.duplicate_count(forecast(spark, d))


@query("fc_clean", "WITH " + FORECAST + """
SELECT zone, strftime(issue_date, '%Y-%m-%d') AS issue_date, lead_day, strftime(valid_local, '%Y-%m-%d %H:%M:%S') AS valid_local,
  COALESCE(ROUND(t, 6), -99.0) AS temp, is_complete FROM fc""")
def fc_clean(spark, d):
    out = FC.clean_forecast(forecast(spark, d))
    return out.select("zone", day("issue_date"), "lead_day", ts_text("valid_local").alias("valid_local"),
                      F.coalesce(rnd("Temp_F", 6), F.lit(-99.0)).alias("temp"), "is_complete")


@query("fc_coverage", "WITH " + FORECAST + """,
i AS (SELECT zone, issue_date, MAX(is_complete) AS c FROM fc GROUP BY 1, 2)
SELECT zone, COUNT(*) AS n_issue_dates, CAST(SUM(c) AS BIGINT) AS n_complete, CAST(SUM(1 - c) AS BIGINT) AS n_partial,
  strftime(MIN(issue_date), '%Y-%m-%d') AS first_issue, strftime(MAX(issue_date), '%Y-%m-%d') AS last_issue FROM i GROUP BY 1""")
def fc_coverage(spark, d):
    c = FC.coverage(FC.clean_forecast(forecast(spark, d)))
    return c.select("zone", "n_issue_dates", "n_complete", "n_partial", day("first_issue"), day("last_issue"))


@query("fc_archive_window", "WITH " + FORECAST + """
SELECT zone, lead_day, COUNT(*) AS n FROM fc WHERE CAST(valid_local AS DATE) BETWEEN DATE '2024-03-05' AND DATE '2024-10-30' GROUP BY ALL""")
def fc_archive_window(spark, d):
    from datetime import date
    out = FC.within_archive(FC.clean_forecast(forecast(spark, d)), date(2024, 1, 1), date(2024, 12, 31),
                            date(2024, 3, 5), date(2024, 10, 28))
    return out.groupBy("zone", "lead_day").agg(F.count(F.lit(1)).alias("n"))


@query("fc_reshape", "WITH " + HOURLY + """,
w AS (SELECT zone, lt, MIN(t) AS t, MIN(h) AS h FROM hourly GROUP BY 1, 2),
l AS (SELECT zone, lt, h, unnest([1, 2]) AS lead_day, t FROM w WHERE NOT (CAST(zone AS INTEGER) % 5 = 0))
SELECT zone, strftime(CAST(lt AS DATE) - lead_day, '%Y-%m-%d') AS issue_date, lead_day, strftime(lt, '%Y-%m-%d %H:%M:%S') AS valid_local,
  COALESCE(CASE WHEN h % 31 = 4 THEN NULL ELSE ROUND(t + lead_day, 6) END, -99.0) AS temp FROM l
UNION ALL SELECT zone, strftime(CAST(lt AS DATE) - 1, '%Y-%m-%d'), 1, strftime(lt, '%Y-%m-%d %H:%M:%S'),
  COALESCE(CASE WHEN h % 31 = 4 THEN NULL ELSE ROUND(t + 1, 6) END, -99.0) FROM w WHERE CAST(zone AS INTEGER) % 5 = 0""")
def fc_reshape(spark, d):
    """Text columns per lead -> long rows; every fifth zone has no lead 2 at all."""
    w = hourly(spark, d).groupBy("zone", F.col("ts_local").alias("time")).agg(
        F.min("Temp_F").alias("t"), F.min("h").alias("h"))

    def cell(lead):
        text = (F.col("t") + lead).cast("string")
        return F.when(F.col("h") % 31 == 4, "n/a").otherwise(text)

    wide = w.select("zone", "time", cell(1).alias("temperature_2m_previous_day1"),
                    F.when(F.col("zone").cast("int") % 5 != 0, cell(2)).alias("temperature_2m_previous_day2"))
    out = WX.reshape_forecast(wide)
    return out.select("zone", day("issue_date"), "lead_day", ts_text("valid_local").alias("valid_local"),
                      F.coalesce(rnd("Temp_F", 6), F.lit(-99.0)).alias("temp"))


@query("fc_sorted_union", "WITH " + FORECAST + """
SELECT zone, strftime(issue_date, '%Y-%m-%d') AS issue_date, COUNT(*) AS n_rows, strftime(MIN(valid_local), '%Y-%m-%d %H:%M:%S') AS first_hour
FROM fc GROUP BY ALL""")
def fc_sorted_union(spark, d):
    """Shards cut by lead put back together, then walked in issue order."""
    fc = forecast(spark, d)
    whole = FC.clean_forecast(T.union_shards(fc.where("lead_day = 1"), fc.where("lead_day = 2")))
    out = FC.ordered(whole).groupBy("zone", "issue_date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("valid_local").alias("f"))
    return out.select("zone", day("issue_date"), "n_rows", ts_text("f").alias("first_hour"))


ARRAYS = """,
fa0 AS (SELECT zone, issue_date, lead_day, hour(valid_local) AS hr, AVG(t) AS t FROM fc WHERE is_complete = 1 GROUP BY ALL),
fa AS (SELECT zone, issue_date FROM fa0 GROUP BY 1, 2 HAVING COUNT(t) = 48)"""


@query("fc_arrays", "WITH " + FORECAST + ARRAYS + """
SELECT zone, strftime(issue_date, '%Y-%m-%d') AS issue_date, (lead_day - 1) * 24 + hr AS idx, ROUND(t, 6) AS value
FROM fa0 JOIN fa USING (zone, issue_date)""")
def fc_arrays(spark, d):
    a = S.forecast_arrays(FC.clean_forecast(forecast(spark, d)))
    long = a.select("zone", "issue_date", F.posexplode(F.concat("d0", "d1")).alias("idx", "v"))
    return long.select("zone", day("issue_date"), "idx", r6("v", "value"))


@query("fc_missing_cells", """
SELECT 2 AS lead_day, CAST(h AS INTEGER) AS hour, COUNT(*) AS n_events FROM (
  SELECT unnest(range(24)) AS h) JOIN events ON true WHERE h < 3 GROUP BY ALL""")
def fc_missing_cells(spark, d):
    """Lead 2 loses the hours before 3; the gap check names exactly those cells."""
    cut = forecast(spark, d).where("NOT (lead_day = 2 AND hour(valid_local) < 3)").withColumn("is_complete", F.lit(1))
    miss = S.missing_forecast_cells(cut)
    n = spark.read.parquet(f"{d}/events.parquet").agg(F.count(F.lit(1)))
    return miss.select("lead_day", "hour", n.scalar().alias("n_events"))


@query("fc_unforecastable", "WITH " + FORECAST + index_sql() + ARRAYS + f"""
SELECT i.zone, {DAY} FROM idx i LEFT JOIN fa ON fa.zone = i.zone AND fa.issue_date = i.target_day - 2 WHERE fa.zone IS NULL""")
def fc_unforecastable(spark, d):
    fc = FC.clean_forecast(forecast(spark, d))
    return S.unforecastable(usable(hourly(spark, d)), fc).select("zone", day())


@query("fc_reference", "WITH " + HOURLY + index_sql() + f""",
o AS (SELECT i.zone, i.target_day, h.hr, h.t FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 48),
a AS (SELECT zone, target_day, AVG(t) AS m FROM o GROUP BY 1, 2),
r AS (SELECT zone, target_day, hr, AVG(t) AS m FROM o GROUP BY 1, 2, 3),
g AS (SELECT zone, target_day, m, unnest(range(24)) AS idx FROM a)
SELECT g.zone, strftime(g.target_day, '%Y-%m-%d') AS target_day, g.idx, ROUND(COALESCE(r.m, g.m), 6) AS value
FROM g LEFT JOIN r ON r.zone = g.zone AND r.target_day = g.target_day AND r.hr = g.idx""")
def fc_reference(spark, d):
    h = hourly(spark, d)
    return exploded(S.forecast_reference(h, usable(h), 48, "clock"), "ref")


FEATURES = """,
fw AS (SELECT i.zone, i.target_day, i.cutoff - h.p AS off, h.hr, h.t FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 48),
ws AS (SELECT zone, target_day, AVG(t) AS m, SUM(GREATEST(0, t - 65)) / 2.0 AS wc, SUM(GREATEST(0, 65 - t)) / 2.0 AS wh,
  MAX(CASE WHEN off <= 24 THEN t END) AS pm FROM fw GROUP BY 1, 2),
wr AS (SELECT zone, target_day, hr, AVG(t) AS m FROM fw GROUP BY 1, 2, 3),
fd AS (SELECT f.zone, f.issue_date + 2 AS target_day,
  SUM(CASE WHEN lead_day = 1 THEN GREATEST(0, t - 65) END) AS c0, SUM(CASE WHEN lead_day = 2 THEN GREATEST(0, t - 65) END) AS c1,
  SUM(CASE WHEN lead_day = 2 THEN GREATEST(0, 65 - t) END) AS h1, MAX(CASE WHEN lead_day = 1 THEN t END) AS m0,
  MAX(CASE WHEN lead_day = 2 THEN t END) AS m1, AVG(CASE WHEN lead_day = 2 AND hr BETWEEN 14 AND 19 THEN t END) AS pk,
  CAST(AVG(CASE WHEN lead_day = 1 THEN t END) >= 55 AS INTEGER) + CAST(AVG(CASE WHEN lead_day = 2 THEN t END) >= 55 AS INTEGER) AS hd
  FROM fa0 f JOIN fa USING (zone, issue_date) GROUP BY 1, 2),
feat AS (
  SELECT ws.zone, ws.target_day, f.hr AS idx, f.t - COALESCE(wr.m, ws.m) AS v
  FROM ws JOIN fa ON fa.zone = ws.zone AND fa.issue_date = ws.target_day - 2
  JOIN fa0 f ON f.zone = fa.zone AND f.issue_date = fa.issue_date AND f.lead_day = 2
  LEFT JOIN wr ON wr.zone = ws.zone AND wr.target_day = ws.target_day AND wr.hr = f.hr
  UNION ALL
  SELECT ws.zone, ws.target_day, unnest([24, 25, 26, 27, 28, 29, 30, 31]),
    unnest([c1 - wc, h1 - wh, m0 - pm, m1 - m0, c0 + c1 - 2 * wc, m1, pk, hd]) FROM ws JOIN fd USING (zone, target_day))"""


@query("fc_features", "WITH " + FORECAST + index_sql() + ARRAYS + FEATURES + f"""
SELECT zone, {DAY}, idx, ROUND(v, 5) + 0.0 AS value FROM feat""")
def fc_features(spark, d):
    h = hourly(spark, d)
    limit = h.select("zone").distinct().withColumn("threshold", F.lit(55.0))
    out = S.forecast_features(h, usable(h), FC.clean_forecast(forecast(spark, d)), limit, 48, "clock")
    return exploded(out, "fc", 5)


# ---- whole samples -------------------------------------------------------------------------

def cleaned(spark, d):
    """The cleaned hourly table, written once like any ingest result."""
    return T.stage(calendar_hourly(spark, d), "cleaned")


def samples_of(spark, d, cfg=CFG):
    return S.build_samples(cleaned(spark, d), T.stage(FC.clean_forecast(forecast(spark, d)), "forecast"), cfg)


ALL_STATICS = ("WITH " + FORECAST + index_sql() + TARGETS + CALENDAR + MACRO + REFS.format(thr=75) + ARRAYS
       + FEATURES.replace(">= 55", ">= 75").replace("fd AS (SELECT f.zone", "fdd AS (SELECT f.zone").replace("JOIN fd USING", "JOIN fdd USING") + """,
keep AS (SELECT i.zone, i.target_day FROM idx i JOIN fa ON fa.zone = i.zone AND fa.issue_date = i.target_day - 2
  WHERE EXISTS (SELECT 1 FROM tgt t WHERE t.zone = i.zone AND t.d = i.target_day)),
st AS (
  SELECT zone, target_day, unnest(range(4)) AS idx, unnest(v) AS v FROM macro
  UNION ALL SELECT zone, target_day, unnest(range(4, 11)), unnest(v) FROM thermal
  UNION ALL SELECT zone, target_day, idx + 11, v FROM feat
  UNION ALL SELECT zone, d, unnest(range(43, 49)), unnest(v) FROM cal
  UNION ALL SELECT zone, d, slot + 49, y FROM tgt)""")


@query("sample_full", ALL_STATICS + f"""
SELECT zone, {DAY}, idx, ROUND(v, 4) + 0.0 AS value FROM keep JOIN st USING (zone, target_day)""")
def sample_full(spark, d):
    """Statics, calendar and target of every training sample, from one plan."""
    s = samples_of(spark, d).withColumn("all", F.concat("macro", "thermal", "fc", "calendar", "y"))
    return exploded(s, "all", 4)


@query("sample_statuses", "WITH " + FORECAST + index_sql() + ARRAYS + TARGETS + """,
x AS (SELECT i.zone, i.target_day, CASE WHEN i.status <> 'ok' THEN i.status WHEN fa.zone IS NULL THEN 'no_forecast'
    WHEN t.d IS NULL THEN 'bad_target' ELSE 'ok' END AS status
  FROM idx_all i LEFT JOIN fa ON fa.zone = i.zone AND fa.issue_date = i.target_day - 2
  LEFT JOIN (SELECT DISTINCT zone, d FROM tgt) t ON t.zone = i.zone AND t.d = i.target_day)
SELECT zone, status, COUNT(*) AS n FROM x GROUP BY ALL""")
def sample_statuses(spark, d):
    h = cleaned(spark, d)
    refs = S.fit_thermal_refs(h, CFG.test_frac, position="clock")
    out = S.assemble(h, FC.clean_forecast(forecast(spark, d)), CFG, refs)
    return out.groupBy("zone", "status").agg(F.count(F.lit(1)).alias("n"))


@query("sample_statuses_sparse", "WITH " + HOURLY.replace("hourly AS (", "whole AS (", 1) + """,
hourly AS (SELECT * FROM whole WHERE h % 211 >= 5)""" + index_sql() + TARGETS + """,
wn AS (SELECT i.zone, i.target_day, COUNT(*) AS n FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - 72 GROUP BY 1, 2),
x AS (SELECT i.zone, CASE WHEN i.status <> 'ok' THEN i.status WHEN COALESCE(wn.n, 0) < 72 THEN 'nan_lookback'
    WHEN t.d IS NULL THEN 'bad_target' ELSE 'ok' END AS status
  FROM idx_all i LEFT JOIN wn USING (zone, target_day)
  LEFT JOIN (SELECT DISTINCT zone, d FROM tgt) t ON t.zone = i.zone AND t.d = i.target_day)
SELECT zone, status, COUNT(*) AS n FROM x GROUP BY ALL""")
def sample_statuses_sparse(spark, d):
    """Five hours are missing now and then: by the clock, a window over such a hole is no window."""
    h = cleaned(spark, d).where("h % 211 >= 5")
    refs = S.fit_thermal_refs(h, CFG.test_frac, position="clock")
    return S.assemble(h, None, CFG, refs).groupBy("zone", "status").agg(F.count(F.lit(1)).alias("n"))


@query("sample_sequence_scaled", "WITH " + FORECAST + index_sql() + ARRAYS + TARGETS + f""",
sq AS (SELECT *, SUM(GREATEST(0, t - 65)) OVER (PARTITION BY zone ORDER BY ts_utc ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS cum FROM hourly),
tn AS (SELECT zone, MIN(p) + CAST(floor(COUNT(*) * 0.8) AS BIGINT) AS cut FROM hourly GROUP BY 1),
sc AS (SELECT zone, AVG(load_est) AS m0, stddev_pop(load_est) AS s0, AVG(t) AS m1, stddev_pop(t) AS s1, AVG(cum) AS m2,
  CASE WHEN stddev_pop(cum) = 0 THEN 1 ELSE stddev_pop(cum) END AS s2 FROM sq JOIN tn USING (zone) WHERE p < cut GROUP BY 1),
keep AS (SELECT i.* FROM idx i JOIN fa ON fa.zone = i.zone AND fa.issue_date = i.target_day - 2
  WHERE EXISTS (SELECT 1 FROM tgt t WHERE t.zone = i.zone AND t.d = i.target_day))
SELECT zone, target_day, lag, ROUND(c0, 4) + 0.0 AS c0, ROUND(c1, 4) + 0.0 AS c1, ROUND(c2, 4) + 0.0 AS c2 FROM (
  SELECT i.zone, {DAY}, 48 - (i.cutoff - q.p) AS lag, (q.load_est - m0) / s0 AS c0, (q.t - m1) / s1 AS c1, (q.cum - m2) / s2 AS c2
  FROM keep i JOIN sq q ON q.zone = i.zone AND q.p < i.cutoff AND q.p >= i.cutoff - 48 JOIN sc ON sc.zone = i.zone)""")
def sample_sequence_scaled(spark, d):
    """The window standardised by the train rows; statics ride along once per sample."""
    from hourcast.operators.rolling import add_thermal_sequence
    from hourcast.operators.scaling import fit_scaler
    h = cleaned(spark, d)
    rows = S.mark_train(add_thermal_sequence(h, position="clock"), 0.2, "clock")
    scaler = fit_scaler(rows, list(CFG.seq_cols), F.col("is_train"))
    # Both scalers read the samples: they are built once.
    samples = T.stage(S.build_samples(h, T.stage(FC.clean_forecast(forecast(spark, d)), "forecast"), CFG), "samples")
    out = tensor(samples, scaler, list(CFG.seq_cols), 0.2)
    rounded = F.transform("seq", lambda r: F.transform(r, lambda v: rnd(v, 4)))  # not exploded by name, see ``exploded``
    long = out.select("zone", "target_day", F.posexplode(rounded).alias("lag", "r"))
    return long.select("zone", day(), "lag", *[F.col("r")[i].alias(f"c{i}") for i in range(3)])


@query("scale_statics", ALL_STATICS + f""",
sv AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone, idx ORDER BY target_day) AS no, COUNT(*) OVER (PARTITION BY zone, idx) AS n
       FROM keep JOIN st USING (zone, target_day) WHERE idx < 43),
sf AS (SELECT zone, idx, AVG(v) AS m, stddev_pop(v) AS s FROM sv WHERE no <= floor(n * 0.8) GROUP BY 1, 2)
SELECT zone, {DAY}, idx, ROUND((v - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END, 3) + 0.0 AS value FROM sv JOIN sf USING (zone, idx)""")
def scale_statics_query(spark, d):
    """Static blocks standardised by the first 80 % of each zone's samples."""
    s = samples_of(spark, d)
    out = scale_statics(s, fit_static_scaler(s, 0.2))
    return exploded(out, "statics", 3)


@query("sample_causality", "WITH " + HOURLY + index_sql() + """,
l AS (SELECT zone, MAX(ld) AS m FROM hourly GROUP BY 1)
SELECT i.zone, COUNT(*) AS n_compared, CAST(0 AS BIGINT) AS n_moved FROM idx i JOIN l USING (zone) GROUP BY 1""")
def sample_causality(spark, d):
    """Rows from the last cutoff on are disturbed; no sample cut off before them may move."""
    from hourcast.operators.diagnostics import parity
    h = cleaned(spark, d)
    refs = S.fit_thermal_refs(h, CFG.test_frac, position="clock")
    last = h.groupBy("zone").agg(F.max(F.to_date("ts_local")).alias("_l"))
    hit = F.to_date("ts_local") >= F.date_sub("_l", 1)
    shaken = h.join(last, "zone").withColumns({c: F.when(hit, F.col(c) + 50).otherwise(F.col(c))
                                               for c in ("load_est", "Temp_F")}).drop("_l")
    a, b = (S.assemble(x, None, CFG, refs).where("status IN ('ok', 'bad_target')") for x in (h, T.stage(shaken, "shaken")))
    moved = parity(a, b, ["zone", "target_day"], ["seq", "macro", "thermal"], 1e-9)
    n = a.groupBy("zone").agg(F.count(F.lit(1)).alias("n_compared"))
    m = moved.groupBy("zone").agg(F.count(F.lit(1)).alias("n_moved"))
    return n.join(m, "zone", "left").select("zone", "n_compared", F.coalesce("n_moved", F.lit(0)).cast("bigint").alias("n_moved"))
