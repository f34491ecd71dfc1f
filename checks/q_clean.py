"""Cleaning, alignment, calendar and time zone queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.functions import day_hours, is_us_holiday, local_status, truthy, cyclic
from hourcast.operators import align as A, quality as Q
from hourcast.operators.chunks import keep_first
from hourcast.operators.regimes import season_of
from hourcast.operators.samples import sample_index
from hourcast.sources.load import clean_preliminary

from .registry import query, rnd
from .views import (CFG, HOURLY, SPARSE, TAIL, TZ, hourly, hourly_sparse, r6, table, tail_unlabelled,
                    ts_text)

TS = "strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc"
LT = "strftime(lt, '%Y-%m-%d %H:%M:%S') AS ts_local"


HOLIDAYS = "(" + ", ".join(f"DATE '{x}'" for x in """
1995-01-02 1995-01-16 1995-02-20 1995-05-29 1995-07-04 1995-09-04 1995-10-09 1995-11-10 1995-11-23 1995-12-25
1996-01-01 1996-01-15 1996-02-19 1996-05-27 1996-07-04 1996-09-02 1996-10-14 1996-11-11 1996-11-28 1996-12-25
1997-01-01 1997-01-20 1997-02-17 1997-05-26 1997-07-04 1997-09-01 1997-10-13 1997-11-11 1997-11-27 1997-12-25
1998-01-01 1998-01-19 1998-02-16 1998-05-25 1998-07-03 1998-09-07 1998-10-12 1998-11-11 1998-11-26 1998-12-25
1999-01-01 1999-01-18 1999-02-15 1999-05-31 1999-07-05 1999-09-06 1999-10-11 1999-11-11 1999-11-25 1999-12-24 1999-12-31
2000-01-17 2000-02-21 2000-05-29 2000-07-04 2000-09-04 2000-10-09 2000-11-10 2000-11-23 2000-12-25
2001-01-01 2001-01-15 2001-02-19 2001-05-28 2001-07-04 2001-09-03 2001-10-08 2001-11-12 2001-11-22 2001-12-25
2024-01-01 2024-10-14 2024-11-11 2024-11-28""".split()) + ")"


def keyed(df, *cols):
    return df.select("zone", ts_text("ts_utc").alias("ts_utc"), *cols)


@query("clean_unverified_tail", "WITH " + HOURLY + f""",
lv AS (SELECT zone, MAX(CASE WHEN lower(trim(is_verified)) IN ('true', '1') THEN ts_utc END) AS m FROM hourly GROUP BY 1)
SELECT zone, {TS}, ROUND(load, 6) AS load FROM hourly JOIN lv USING (zone) WHERE ts_utc <= m""")
def clean_unverified_tail(spark, d):
    return keyed(Q.drop_unverified_tail(hourly(spark, d)), r6("load"))


SPIKED = """,
spiked AS (SELECT * REPLACE (CASE WHEN h % 131 = 7 OR h = lo OR h = hi THEN load_est * 30 ELSE load_est END AS load_est) FROM {src}),
qs AS (SELECT zone, quantile_cont(load_est, 0.25) AS q1, quantile_cont(load_est, 0.75) AS q3 FROM spiked GROUP BY 1),
cut AS (SELECT s.zone, s.ts_utc, ROW_NUMBER() OVER (PARTITION BY s.zone ORDER BY s.ts_utc) AS k,
  CASE WHEN load_est > q3 + 10 * (q3 - q1) THEN NULL ELSE load_est END AS x FROM spiked s JOIN qs USING (zone))"""


def spiked(df):
    hit = (F.col("h") % 131 == 7) | (F.col("h") == F.col("lo")) | (F.col("h") == F.col("hi"))
    return df.withColumn("load_est", F.when(hit, F.col("load_est") * 30).otherwise(F.col("load_est")))


@query("clean_upper_outliers", "WITH " + HOURLY + SPIKED.format(src="hourly") + f"""
SELECT zone, {TS}, COALESCE(ROUND(x, 6), -1.0) AS load_est FROM cut""")
def clean_upper_outliers(spark, d):
    out = Q.null_upper_outliers(spiked(hourly(spark, d)), "load_est")
    return keyed(out, F.coalesce(rnd("load_est", 6), F.lit(-1.0)).alias("load_est"))


LINE = """,
nb AS (SELECT *,
  last_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY zone ORDER BY k) AS k0,
  first_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY zone ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k1,
  last_value(x IGNORE NULLS) OVER (PARTITION BY zone ORDER BY k) AS x0,
  first_value(x IGNORE NULLS) OVER (PARTITION BY zone ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1
  FROM cut),
line AS (SELECT *, CASE WHEN x IS NOT NULL THEN x WHEN k0 IS NOT NULL AND k1 IS NOT NULL
                        THEN x0 + (x1 - x0) * (k - k0) / (k1 - k0) END AS inside FROM nb)"""


@query("clean_preliminary", "WITH " + SPARSE + SPIKED.format(src="sparse") + LINE + f"""
SELECT zone, {TS}, ROUND(COALESCE(inside, x0, x1), 6) AS load_est FROM line""")
def clean_prelim(spark, d):
    """Outliers bridged by row position over a series with real gaps."""
    rows = spiked(hourly_sparse(spark, d)).select("zone", "ts_utc", "load_est")
    return keyed(clean_preliminary(rows), r6("load_est"))


@query("clean_rescale", "WITH " + HOURLY + f"""
SELECT zone, {TS}, ROUND(load_est / CASE zone WHEN '1' THEN 8.8 WHEN '3' THEN 2.0 ELSE 1.0 END, 6) AS load_est FROM hourly""")
def clean_rescale(spark, d):
    return keyed(Q.rescale(hourly(spark, d), "load_est", {"1": 8.8, "3": 2.0}), r6("load_est"))


@query("clean_labels_and_repair", "WITH " + TAIL + """,
bad AS (SELECT zone, bool_or(COALESCE(load <= 0, false)) AS hit FROM tail GROUP BY 1),
cut AS (SELECT t.zone, t.ts_utc, t.load, b.hit, t.h AS k, CASE WHEN load > 0 THEN load END AS x
        FROM tail t JOIN bad b USING (zone))""" + LINE + f"""
SELECT zone, {TS}, CAST(load IS NOT NULL AS INTEGER) AS has_label,
  COALESCE(ROUND(CASE WHEN hit THEN inside ELSE load END, 6), -1.0) AS load FROM line""")
def clean_labels(spark, d):
    """Zones without an impossible value keep their interior nulls; tails stay unlabelled."""
    out = Q.repair_impossible(Q.flag_labels(tail_unlabelled(spark, d)), position="clock")
    return keyed(out, "has_label", F.coalesce(rnd("load", 6), F.lit(-1.0)).alias("load"))


VALID = """,
st AS (SELECT zone, month(lt) AS mo, hr, AVG(load) AS m, stddev_samp(load) AS s FROM tail GROUP BY ALL),
vd AS (SELECT t.*, CAST(COALESCE(ABS((load - m) / (s + 1e-6)) <= 1.5, false) AS INTEGER) AS ok
       FROM tail t JOIN st ON st.zone = t.zone AND st.mo = month(t.lt) AND st.hr = t.hr)"""


@query("clean_validity", "WITH " + TAIL + VALID + f"""
SELECT zone, {TS}, ok AS is_valid FROM vd""")
def clean_validity(spark, d):
    """A tighter limit than the default 3 so that the synthetic load has outliers to flag."""
    df = tail_unlabelled(spark, d)
    df = Q.flag_labels(df).withColumns({"hour": F.hour("ts_local"), "month": F.month("ts_local")})
    return keyed(Q.flag_validity(df, limit=1.5), "is_valid")


@query("clean_full", "WITH " + TAIL + """,
bad AS (SELECT zone, bool_or(COALESCE(load <= 0, false)) AS hit FROM tail GROUP BY 1),
cut AS (SELECT t.zone, t.ts_utc, t.lt, t.hr, t.load, b.hit, t.h AS k, CASE WHEN load > 0 THEN load END AS x
        FROM tail t JOIN bad b USING (zone))""" + LINE + f""",
rep AS (SELECT zone, ts_utc, lt, hr, CAST(load IS NOT NULL AS INTEGER) AS has_label, CASE WHEN hit THEN inside ELSE load END AS y FROM line),
st AS (SELECT zone, month(lt) AS mo, hr, AVG(y) AS m, stddev_samp(y) AS s FROM rep GROUP BY ALL),
fl AS (SELECT zone, MIN(lt) AS first_lt FROM tail GROUP BY 1)
SELECT r.zone, {TS}, has_label, COALESCE(ROUND(y, 6), -1.0) AS load,
  CAST(COALESCE(ABS((y - m) / (s + 1e-6)) <= 3, false) AND has_label = 1 AS INTEGER) AS is_valid,
  CAST(CAST(lt AS DATE) IN {HOLIDAYS} AND CAST(CAST(lt AS DATE) AS TIMESTAMP) >= first_lt AS INTEGER) AS is_holiday
FROM rep r JOIN st ON st.zone = r.zone AND st.mo = month(r.lt) AND st.hr = r.hr JOIN fl ON fl.zone = r.zone""")
def clean_full(spark, d):
    """Label flag, repair, calendar and validity in one plan."""
    out = Q.clean(tail_unlabelled(spark, d), "clock")
    return keyed(out, "has_label", F.coalesce(rnd("load", 6), F.lit(-1.0)).alias("load"), "is_valid", "is_holiday")


@query("clean_gaps", "WITH " + SPARSE + f"""
SELECT zone, {TS}, ROUND(step, 6) AS step_hours FROM (
  SELECT zone, ts_utc, CAST(p - LAG(p) OVER (PARTITION BY zone ORDER BY p) AS DOUBLE) AS step FROM sparse) WHERE step <> 1""")
def clean_gaps(spark, d):
    return keyed(Q.gaps(hourly_sparse(spark, d)), r6("step_hours"))


@query("clean_alignment_report", "WITH " + SPARSE + """,
g AS (SELECT zone, COUNT(*) AS n_gaps FROM (
  SELECT zone, p - LAG(p) OVER (PARTITION BY zone ORDER BY p) AS step FROM sparse) WHERE step > 1.5 GROUP BY 1)
SELECT zone, CAST(SUM(1 + CAST(h % 10 = 0 AS INTEGER)) AS BIGINT) AS n_rows, COUNT(*) AS n_hours,
  CAST(SUM(CAST(h % 10 = 0 AS INTEGER)) AS BIGINT) AS n_duplicates, COALESCE(ANY_VALUE(g.n_gaps), 0) AS n_gaps
FROM sparse LEFT JOIN g USING (zone) GROUP BY 1""")
def clean_alignment_report(spark, d):
    s = hourly_sparse(spark, d)
    return Q.alignment_report(s.unionByName(s.where("h % 10 = 0")))


@query("clean_fill_weather", "WITH " + SPARSE + """,
cut AS (SELECT zone, ts_utc, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY ts_utc) AS k,
  CASE WHEN h % 5 < 3 OR h < lo + 20 THEN NULL ELSE t END AS x FROM sparse)""" + LINE + f"""
SELECT zone, {TS}, ROUND(COALESCE(x0, x1), 6) AS temp FROM line""")
def clean_fill_weather(spark, d):
    s = hourly_sparse(spark, d)
    holed = s.withColumn("Temp_F", F.when((F.col("h") % 5 < 3) | (F.col("h") < F.col("lo") + 20), None)
                         .otherwise(F.col("Temp_F")))
    return keyed(Q.fill_forward_back(holed, ["Temp_F"]), r6("Temp_F", "temp"))


@query("clean_training_view", "WITH " + TAIL + f"SELECT zone, {TS}, ROUND(load, 6) AS load FROM tail WHERE load IS NOT NULL")
def clean_training_view(spark, d):
    return keyed(Q.training_view(Q.flag_labels(tail_unlabelled(spark, d))), r6("load"))


@query("clean_complete_days", "WITH " + HOURLY + f"""
SELECT zone, strftime(ld, '%Y-%m-%d') AS local_date, COUNT(*) AS n_hours FROM hourly GROUP BY zone, ld
HAVING hour(MAX(lt)) = 23 AND COUNT(*) = CAST((epoch(timezone('{TZ}', CAST(ld + 1 AS TIMESTAMP))) - epoch(timezone('{TZ}', CAST(ld AS TIMESTAMP)))) / 3600 AS INTEGER)""")
def clean_complete_days(spark, d):
    c = Q.complete_days(hourly(spark, d), TZ)
    return c.select("zone", F.col("local_date").cast("string").alias("local_date"), "n_hours")


@query("clean_keep_first", """
SELECT zone, day, first_key, ROUND(first_price, 6) AS first_price FROM (
  SELECT o_orderpriority AS zone, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS first_key, o_totalprice AS first_price,
    ROW_NUMBER() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1""")
def clean_keep_first(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("zone"), F.to_date("o_orderdate").cast("string").alias("day"),
        F.col("o_orderkey").alias("first_key"), rnd("o_totalprice", 6).alias("first_price"))
    return keep_first(o, ["zone", "day"], ["first_key"])


@query("clean_split_hours", "WITH " + HOURLY + """,
dy AS (SELECT DISTINCT zone, ld, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY ld) AS k
       FROM (SELECT DISTINCT zone, ld FROM hourly))
SELECT h.zone, strftime(h.ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, ROUND(load, 6) AS load
FROM hourly h JOIN dy ON dy.zone = h.zone AND dy.ld = h.ld WHERE k > 1 AND isodow(h.ld) = 3 AND is_valid = 1""")
def clean_split_hours(spark, d):
    h = hourly(spark, d)
    days = sample_index(h, CFG).where(F.weekday("target_day") == 2).select("zone", "target_day")
    return keyed(Q.split_hours(h, days), r6("load"))


# ---- alignment -----------------------------------------------------------------------------

LOADS = TAIL + """,
met AS (SELECT zone, ts_utc, load, lt FROM tail WHERE load IS NOT NULL),
pre AS (SELECT zone, ts_utc, load_est FROM tail WHERE h % 7 <> 2),
loads AS (SELECT COALESCE(m.zone, p.zone) AS zone, COALESCE(m.ts_utc, p.ts_utc) AS ts_utc, m.load, p.load_est
  FROM met m FULL JOIN pre p ON p.zone = m.zone AND p.ts_utc = m.ts_utc)"""


def _loads(spark, d):
    t = tail_unlabelled(spark, d)
    met = t.where("load IS NOT NULL").select("zone", "ts_utc", "ts_local", "load")
    return met, t.where("h % 7 <> 2").select("zone", "ts_utc", "load_est")


@query("align_join_loads", "WITH " + LOADS + f"""
SELECT zone, {TS}, strftime(timezone('{TZ}', timezone('UTC', ts_utc)), '%Y-%m-%d %H:%M:%S') AS ts_local,
  COALESCE(ROUND(load, 6), -1.0) AS load, COALESCE(ROUND(load_est, 6), -1.0) AS load_est FROM loads""")
def align_join_loads(spark, d):
    out = A.join_loads(*_loads(spark, d), TZ)
    return keyed(out, ts_text("ts_local").alias("ts_local"), *[
        F.coalesce(rnd(c, 6), F.lit(-1.0)).alias(c) for c in ("load", "load_est")])


WALL = """,
wall AS (  -- the wall clock of every hour, as a weather source with 24 rows a day would stamp it
  SELECT zone, h, t, CAST(ts_utc - INTERVAL 5 HOUR AS TIMESTAMP) AS l FROM hourly),
wu AS (SELECT *, timezone('UTC', timezone('{tz}', l)) AS u FROM wall),
wok AS (SELECT *, timezone('{tz}', timezone('UTC', u)) = l AS exist,
  timezone('{tz}', timezone('UTC', u + INTERVAL 1 HOUR)) = l OR timezone('{tz}', timezone('UTC', u - INTERVAL 1 HOUR)) = l AS twice FROM wu)""".format(tz=TZ)


def _wall(spark, d):
    h = hourly(spark, d)
    return h.select("zone", "h", (F.col("ts_utc") - F.expr("INTERVAL 5 HOUR")).cast("timestamp_ntz").alias("time"), "Temp_F")


@query("tz_local_to_utc", "WITH " + HOURLY + WALL + """
SELECT zone, strftime(u, '%Y-%m-%d %H:%M:%S') AS ts_utc, ROUND(t, 6) AS temp FROM wok WHERE exist AND NOT twice""")
def tz_local_to_utc(spark, d):
    """Skipped and repeated hours of the wall clock are both dropped."""
    return keyed(A.to_utc(_wall(spark, d), "time", TZ), r6("Temp_F", "temp"))


@query("tz_local_status", "WITH " + HOURLY + WALL + """
SELECT zone, CASE WHEN NOT exist THEN 'nonexistent' WHEN twice THEN 'ambiguous' ELSE 'ok' END AS status, COUNT(*) AS n
FROM wok GROUP BY ALL""")
def tz_local_status(spark, d):
    return _wall(spark, d).groupBy("zone", local_status(F.col("time"), TZ).alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


@query("tz_utc_to_local", "WITH " + HOURLY + f"SELECT zone, {TS}, {LT} FROM hourly")
def tz_utc_to_local(spark, d):
    h = hourly(spark, d).drop("ts_local")
    return keyed(A.to_local(h, TZ), ts_text("ts_local").alias("ts_local"))


@query("tz_parse_utc", "WITH " + HOURLY + f"SELECT zone, {TS} FROM hourly")
def tz_parse_utc(spark, d):
    """Naive text is UTC, text with an offset is converted."""
    text = F.when(F.col("h") % 2 == 0, ts_text("ts_utc")).otherwise(
        F.concat(ts_text(F.col("ts_utc") - F.expr("INTERVAL 5 HOUR")), F.lit("-05:00")))
    rows = hourly(spark, d).select("zone", F.to_timestamp(text).alias("ts_utc"))
    return keyed(rows)


@query("align_full", "WITH " + LOADS + WALL + """,
w AS (SELECT zone, u AS ts_utc, t FROM wok WHERE exist AND NOT twice),
cut AS (SELECT l.zone, l.ts_utc, l.load, l.load_est, w.t AS x,
  ROW_NUMBER() OVER (PARTITION BY l.zone ORDER BY l.ts_utc) AS k
  FROM loads l LEFT JOIN w ON w.zone = l.zone AND w.ts_utc = l.ts_utc)""" + LINE + f"""
SELECT zone, {TS}, strftime(timezone('{TZ}', timezone('UTC', ts_utc)), '%Y-%m-%d %H:%M:%S') AS ts_local,
  COALESCE(ROUND(load, 6), -1.0) AS load, COALESCE(ROUND(load_est, 6), -1.0) AS load_est,
  ROUND(COALESCE(x0, x1), 6) AS temp FROM line""")
def align_full(spark, d):
    """Loads outer-joined, local weather brought to UTC and left-joined, gaps filled."""
    out = A.align(*_loads(spark, d), _wall(spark, d).drop("h"), TZ, staged=True)
    return keyed(out, ts_text("ts_local").alias("ts_local"),
                 *[F.coalesce(rnd(c, 6), F.lit(-1.0)).alias(c) for c in ("load", "load_est")], r6("Temp_F", "temp"))


# ---- calendar ------------------------------------------------------------------------------

@query("cal_holiday", f"""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CAST(o_orderdate AS DATE) IN {HOLIDAYS} AS INTEGER) AS is_holiday,
  COUNT(*) AS n_orders FROM orders GROUP BY 1, 2""")
def cal_holiday(spark, d):
    """Against a literal list of observed federal holidays."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").groupBy(
        day.cast("string").alias("day"), is_us_holiday(day).cast("int").alias("is_holiday")).agg(
        F.count(F.lit(1)).alias("n_orders"))


@query("cal_columns", "WITH " + HOURLY + f""",
fl AS (SELECT zone, MIN(lt) AS first_lt FROM hourly GROUP BY 1)
SELECT zone, {TS}, hr AS hour, month(lt) AS month, ROUND(sin(2 * pi() * hr / 24), 6) + 0.0 AS hour_sin,
  ROUND(cos(2 * pi() * hr / 24), 6) + 0.0 AS hour_cos, ROUND(sin(2 * pi() * month(lt) / 12), 6) + 0.0 AS month_sin,
  ROUND(cos(2 * pi() * month(lt) / 12), 6) + 0.0 AS month_cos, isodow(lt) - 1 AS dayofweek,
  CAST(isodow(lt) >= 6 AS INTEGER) AS is_weekend,
  CAST(ld IN {HOLIDAYS} AND CAST(ld AS TIMESTAMP) >= first_lt AS INTEGER) AS is_holiday, dayofyear(lt) AS doy
FROM hourly JOIN fl USING (zone)""")
def cal_columns(spark, d):
    out = Q.add_calendar(hourly(spark, d))
    return keyed(out, "hour", "month", *[r6(c) for c in
                 ("hour_sin", "hour_cos", "month_sin", "month_cos")], "dayofweek", "is_weekend",
                 "is_holiday", F.dayofyear("ts_local").alias("doy"))


@query("cal_weekly_cycle", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, ROUND(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS dow_sin,
  ROUND(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS dow_cos,
  CASE WHEN month(o_orderdate) IN (7, 8) THEN 'summer' WHEN month(o_orderdate) IN (6, 9) THEN 'upper_shoulder'
       WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' ELSE 'shoulder' END AS season, COUNT(*) AS n
FROM orders GROUP BY ALL""")
def cal_weekly_cycle(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    s, c = cyclic(F.weekday("day"), 7)
    return o.groupBy(F.col("day").cast("string").alias("day"), rnd(s, 6).alias("dow_sin"),
                     rnd(c, 6).alias("dow_cos"), season_of(F.month("day")).alias("season")).agg(
        F.count(F.lit(1)).alias("n"))


@query("tz_day_hours", f"""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day,
  CAST((epoch(timezone('{TZ}', o_orderdate + INTERVAL 1 DAY)) - epoch(timezone('{TZ}', o_orderdate))) / 3600 AS INTEGER) AS n_hours,
  COUNT(*) AS n_orders FROM orders GROUP BY ALL""")
def tz_day_hours(spark, d):
    """23, 24 or 25 real hours of each order day in New York."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").groupBy(
        day.cast("string").alias("day"), day_hours(day, TZ).alias("n_hours")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("tz_real_hours", "WITH " + HOURLY + f""",
d AS (SELECT DISTINCT zone, ld FROM hourly),
s AS (SELECT zone, ld, timezone('UTC', timezone('{TZ}', CAST(ld AS TIMESTAMP))) AS a,
        timezone('UTC', timezone('{TZ}', CAST(ld + 1 AS TIMESTAMP))) AS b FROM d),
u AS (SELECT zone, ld, unnest(range(a, b, INTERVAL 1 HOUR)) AS ts_utc FROM s)
SELECT zone, strftime(ld, '%Y-%m-%d') AS target_day, {TS},
  strftime(timezone('{TZ}', timezone('UTC', ts_utc)), '%Y-%m-%d %H:%M:%S') AS ts_local,
  hour(timezone('{TZ}', timezone('UTC', ts_utc))) AS hour FROM u""")
def tz_real_hours(spark, d):
    days = hourly(spark, d).select("zone", F.to_date("ts_local").alias("target_day")).distinct()
    out = A.local_day_hours(days, TZ)
    return keyed(out, F.col("target_day").cast("string").alias("target_day"),
                 ts_text("ts_local").alias("ts_local"), "hour")


@query("tz_extend_future", "WITH " + HOURLY + f""",
c AS (SELECT zone, MAX(ld) AS last FROM (SELECT zone, ld, MAX(lt) AS m FROM hourly GROUP BY 1, 2) WHERE hour(m) = 23 GROUP BY 1),
s AS (SELECT zone, timezone('UTC', timezone('{TZ}', CAST(last + 1 AS TIMESTAMP))) AS a,
        timezone('UTC', timezone('{TZ}', CAST(last + 3 AS TIMESTAMP))) AS b FROM c),
u AS (SELECT zone, unnest(range(a, b, INTERVAL 1 HOUR)) AS ts_utc FROM s),
al AS (SELECT zone, ts_utc, load FROM hourly UNION ALL
  SELECT zone, ts_utc, NULL FROM u WHERE NOT EXISTS (SELECT 1 FROM hourly h WHERE h.zone = u.zone AND h.ts_utc = u.ts_utc))
SELECT zone, {TS}, strftime(timezone('{TZ}', timezone('UTC', ts_utc)), '%Y-%m-%d %H:%M:%S') AS ts_local,
  COALESCE(ROUND(load, 6), -1.0) AS load FROM al""")
def tz_extend_future(spark, d):
    out = A.extend_future(hourly(spark, d), 2, TZ)
    return keyed(out, ts_text("ts_local").alias("ts_local"), F.coalesce(rnd("load", 6), F.lit(-1.0)).alias("load"))


@query("text_truthy", "WITH " + HOURLY + """
SELECT zone, lower(trim(is_verified)) IN ('true', '1') AS verified, COUNT(*) AS n FROM hourly GROUP BY ALL""")
def text_truthy(spark, d):
    return hourly(spark, d).groupBy("zone", truthy(F.col("is_verified")).alias("verified")).agg(F.count(F.lit(1)).alias("n"))
