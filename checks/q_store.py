"""Store, serving, joint, streaming and source queries."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F, types as T

from hourcast.operators import baseline as B, diagnostics as D, joint as J, metrics as M, samples as S, store as ST
from hourcast.operators.align import expand_to_real_hours
from hourcast.operators.quality import add_calendar
from hourcast.operators.scaling import fit_target_scaler, invert_scaler
from hourcast.plans import serving as SV
from hourcast.schema import METERED, PRELIMINARY
from hourcast.session import scratch_dir
from hourcast.sources import load as L, tables as TB, weather as WX
from hourcast.sources.versions import VersionedTable, latest_hours, recent_from
from hourcast.streaming import feeds as FD

from .q_clean import TS, keyed
from .q_sample import DAY, cleaned, day
from .q_score import score_sql
from .registry import query, rnd
from .views import (CFG, ERRORS, HOURLY, TZ, _decorate, errors, hourly, index_sql, r6, table, ts_text)

# ---- store ---------------------------------------------------------------------------------

STORE = """,
o AS (SELECT zone, ts_utc, lt, CASE WHEN h - lo < 300 THEN load END AS metered, CASE WHEN h % 13 <> 0 THEN load_est END AS m1 FROM hourly WHERE h - lo < 400),
f AS (SELECT zone, ts_utc, lt, CASE WHEN h - lo < 500 THEN load + 0.5 END AS metered, load_est + 1 AS m1, load_est + 2 AS m2 FROM hourly WHERE h - lo >= 200),
m AS (SELECT COALESCE(o.zone, f.zone) AS zone, COALESCE(o.ts_utc, f.ts_utc) AS ts_utc, COALESCE(f.lt, o.lt) AS lt,
  COALESCE(f.metered, o.metered) AS metered, COALESCE(o.m1, f.m1) AS m1, f.m2 FROM o FULL JOIN f ON f.zone = o.zone AND f.ts_utc = o.ts_utc),
mx AS (SELECT zone, MAX(ts_utc) AS mx FROM m GROUP BY 1)"""


def _stores(spark, d):
    h = hourly(spark, d).withColumn("k", F.col("h") - F.col("lo"))
    old = h.where("k < 400").select("zone", "ts_utc", "ts_local", F.when(F.col("k") < 300, F.col("load")).alias("metered"),
                                    F.when(F.col("h") % 13 != 0, F.col("load_est")).alias("m1_pred"))
    new = h.where("k >= 200").select("zone", "ts_utc", "ts_local", F.when(F.col("k") < 500, F.col("load") + 0.5).alias("metered"),
                                     (F.col("load_est") + 1).alias("m1_pred"), (F.col("load_est") + 2).alias("m2_pred"))
    return old, new


def _wide(df):
    return keyed(df, ts_text("ts_local").alias("ts_local"), *[F.coalesce(rnd(c, 6), F.lit(-1.0)).alias(c)
                                                            for c in ("metered", "m1_pred", "m2_pred")])


_WIDE = f"""SELECT zone, {TS}, strftime(lt, '%Y-%m-%d %H:%M:%S') AS ts_local, COALESCE(ROUND(metered, 6), -1.0) AS metered,
  COALESCE(ROUND(m1, 6), -1.0) AS m1_pred, COALESCE(ROUND(m2, 6), -1.0) AS m2_pred FROM m JOIN mx USING (zone) WHERE ts_utc > mx - INTERVAL {{days}} DAY"""


@query("store_freeze_merge", "WITH " + HOURLY + STORE + _WIDE.format(days=20))
def store_freeze_merge(spark, d):
    return _wide(ST.freeze_merge(*_stores(spark, d), keep_days=20))


@query("store_idempotent", "WITH " + HOURLY + STORE + _WIDE.format(days=10))
def store_idempotent(spark, d):
    """Merging the same fresh rows again changes nothing."""
    old, new = _stores(spark, d)
    once = ST.freeze_merge(old, new)
    return _wide(ST.freeze_merge(once, new))


@query("store_written", "WITH " + HOURLY + STORE + _WIDE.format(days=20))
def store_written(spark, d):
    """Two runs into a written store, with a killed write between them that nobody sees."""
    old, new = _stores(spark, d)
    store = VersionedTable(spark, scratch_dir(spark, "store"))
    SV.merge_into(store, old, keep_days=20)
    old.withColumn("day", F.to_date("ts_utc")).write.partitionBy("day").parquet(f"{store.root}/data/run=killed")
    SV.merge_into(store, new, keep_days=20)
    store.vacuum()
    return _wide(SV.read_store(store))


@query("store_old_version", "WITH " + HOURLY + f"""
SELECT zone, {TS}, COALESCE(ROUND(load, 6), -1.0) AS metered FROM hourly WHERE h - lo < 400""")
def store_old_version(spark, d):
    """A reader keeps the version it opened while the next one is written."""
    old, new = _stores(spark, d)
    store = VersionedTable(spark, scratch_dir(spark, "store"))
    first = SV.merge_into(store, old.withColumn("metered", F.lit(1.0)), keep_days=None)
    both = hourly(spark, d).withColumn("k", F.col("h") - F.col("lo")).where("k < 400")
    second = SV.merge_into(store, both.select("zone", "ts_utc", "ts_local", F.col("load").alias("metered")), keep_days=None)
    assert store.read(first).where("metered <> 1.0").isEmpty() and second.seq == first.seq + 1
    return keyed(SV.read_store(store), F.coalesce(rnd("metered", 6), F.lit(-1.0)).alias("metered"))


@query("store_long_predictions", "WITH " + HOURLY + f"""
SELECT zone, {TS}, 'm1' AS model, ROUND(CASE WHEN h - lo < 400 AND h % 13 <> 0 THEN load_est ELSE load_est + 1 END, 6) AS pred
FROM hourly WHERE (h - lo < 400 AND h % 13 <> 0) OR h - lo >= 200""")
def store_long_predictions(spark, d):
    old, new = _stores(spark, d)
    a, b = (x.select("zone", "ts_utc", F.lit("m1").alias("model"), F.col("m1_pred").alias("pred")) for x in (old, new))
    return keyed(ST.merge_predictions(a, b), "model", r6("pred"))


@query("store_long_actuals", "WITH " + HOURLY + f"""
SELECT zone, {TS}, ROUND(CASE WHEN h - lo < 200 THEN load WHEN h - lo >= 400 THEN load + 1 WHEN h % 3 = 0 AND h % 5 <> 0 THEN load ELSE load + 1 END, 6) AS metered,
  CASE WHEN h - lo < 200 THEN h % 3 = 0 WHEN h - lo >= 400 THEN h % 5 = 0 ELSE h % 3 = 0 OR h % 5 = 0 END AS verified FROM hourly""")
def store_long_actuals(spark, d):
    """Verified beats unverified, then the newer value."""
    h = hourly(spark, d).withColumn("k", F.col("h") - F.col("lo"))
    old = h.where("k < 400").select("zone", "ts_utc", F.col("load").alias("metered"), (F.col("h") % 3 == 0).alias("verified"))
    new = h.where("k >= 200").select("zone", "ts_utc", (F.col("load") + 1).alias("metered"), (F.col("h") % 5 == 0).alias("verified"))
    return keyed(ST.merge_actuals(old, new), r6("metered"), "verified")


PREDS = """,
errs AS (SELECT zone, unnest(['m1', 'm2']) AS model, ROUND(load, 1) AS true_load, unnest([ROUND(load_est, 1), ROUND(load_est + 2 + h % 7, 1)]) AS pred FROM hourly WHERE h % 5 <> 0),
e2 AS (SELECT *, pred - true_load AS signed_error, ABS(pred - true_load) AS abs_error FROM errs)"""


def _long_store(spark, d):
    h = hourly(spark, d)
    preds = h.select("zone", "ts_utc", F.explode(F.array(
        F.struct(F.lit("m1").alias("model"), F.col("load_est").alias("pred")),
        F.struct(F.lit("m2").alias("model"), (F.col("load_est") + 2 + F.col("h") % 7).alias("pred")))).alias("_e"))
    actual = h.select("zone", "ts_utc", "ts_local", F.when(F.col("h") % 5 != 0, F.col("load")).alias("metered"))
    return preds.select("zone", "ts_utc", "_e.model", "_e.pred"), actual


@query("store_scoreboard", "WITH " + HOURLY + PREDS + score_sql("e2", "zone, model") + """
SELECT zone, model, ROUND(mape, 6) AS mape, ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse, ROUND(me, 6) AS me,
  ROUND(brs, 6) AS brs, n_hours AS hours FROM board JOIN slope USING (zone, model)""")
def store_scoreboard(spark, d):
    preds, actual = _long_store(spark, d)
    b = M.store_scoreboard(preds, actual.drop("ts_local"), rounded_scores=False)
    return b.select("zone", "model", *[r6(c) for c in ("mape", "mae", "rmse", "me", "brs")], F.col("hours").cast("bigint").alias("hours"))


@query("store_day_status", "WITH " + HOURLY + """
SELECT zone, strftime(ld, '%Y-%m-%d') AS date, COUNT(CASE WHEN h < hi - 60 AND h % 5 <> 0 THEN 1 END) AS n_actual,
  CASE WHEN COUNT(CASE WHEN h < hi - 60 AND h % 5 <> 0 THEN 1 END) > 0 THEN 'scored' ELSE 'day_ahead' END AS status FROM hourly GROUP BY zone, ld""")
def store_day_status(spark, d):
    h = hourly(spark, d).withColumn("metered", F.when((F.col("h") < F.col("hi") - 60) & (F.col("h") % 5 != 0), F.col("load")))
    return M.day_status(h).select("zone", day("date"), "n_actual", "status")


@query("store_select_models", "WITH " + HOURLY + PREDS + """
SELECT zone, model, 'direct' AS klass, 'tree' AS family, COUNT(*) AS n FROM (SELECT zone, 'm1' AS model FROM hourly) GROUP BY 1, 2""")
def store_select_models(spark, d):
    preds, _ = _long_store(spark, d)
    registry = spark.createDataFrame([("m1", "direct", "tree", 0), ("m2", "residual", "tree", 1)],
                                     "model string, klass string, family string, position int")
    out = ST.select_models(preds, registry, "direct", ["tree"])
    return out.groupBy("zone", "model", "klass", "family").agg(F.count(F.lit(1)).alias("n"))


@query("store_pivot", "WITH " + HOURLY + f"""
SELECT zone, {TS}, ROUND(load_est, 6) AS m1_pred, ROUND(load_est + 2 + h % 7, 6) AS m2_pred,
  COALESCE(CASE WHEN h % 5 <> 0 THEN ROUND(load, 6) END, -1.0) AS metered FROM hourly""")
def store_pivot(spark, d):
    preds, actual = _long_store(spark, d)
    out = ST.pivot_store(preds, actual, ["m1", "m2"])
    return keyed(out, r6("m1_pred"), r6("m2_pred"), F.coalesce(rnd("metered", 6), F.lit(-1.0)).alias("metered"))


@query("score_by_magnitude", "WITH " + ERRORS + """,
m AS (SELECT zone, ROUND(AVG(signed_error), 6) AS me FROM errors GROUP BY 1)
SELECT zone, me, ROW_NUMBER() OVER (ORDER BY ABS(me), zone) AS place FROM m""")
def score_by_magnitude(spark, d):
    """All zones with their place by bias, nearest zero first."""
    s = M.basic_scores(errors(spark, d)).select("zone", r6("me"))
    place = F.row_number().over(W.orderBy(F.abs("me"), "zone"))  # one row a zone
    return TB.by_magnitude(s, "me", "zone").withColumn("place", place)


@query("score_real_hours", "WITH " + ERRORS + f""",
d AS (SELECT DISTINCT zone, date FROM errors),
s AS (SELECT zone, date, timezone('UTC', timezone('{TZ}', CAST(date AS TIMESTAMP))) AS a, timezone('UTC', timezone('{TZ}', CAST(date + 1 AS TIMESTAMP))) AS b FROM d),
u AS (SELECT zone, date, unnest(range(a, b, INTERVAL 1 HOUR)) AS ts_utc FROM s)
SELECT u.zone, {TS}, hour(timezone('{TZ}', timezone('UTC', ts_utc))) AS hour, ROUND(e.pred, 6) AS pred
FROM u JOIN errors e ON e.zone = u.zone AND e.date = u.date AND e.hour = hour(timezone('{TZ}', timezone('UTC', ts_utc)))""")
def score_real_hours(spark, d):
    """24 slots back onto the 23, 24 or 25 hours a day really has."""
    from hourcast.plans.evaluate import naive_forecast
    out = expand_to_real_hours(naive_forecast(hourly(spark, d), CFG), TZ)
    return keyed(out, "hour", r6("yhat", "pred"))


# ---- serving -------------------------------------------------------------------------------

@query("serving_targets", "WITH " + HOURLY + f""",
c AS (SELECT zone, ld FROM (SELECT zone, ld, MAX(lt) AS m FROM hourly GROUP BY 1, 2) WHERE hour(m) = 23),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY ld DESC) AS k FROM c),
t AS (SELECT zone, ld AS target_day FROM r WHERE k <= 8 UNION ALL SELECT zone, ld + CAST(unnest([1, 2]) AS INTEGER) FROM r WHERE k = 1)
SELECT zone, {DAY} FROM t""")
def serving_targets(spark, d):
    return SV.daily_targets(hourly(spark, d)).select("zone", day())


@query("serving_roll", "WITH " + HOURLY + f""",
c AS (SELECT zone, ld FROM (SELECT zone, ld, MAX(lt) AS m FROM hourly GROUP BY 1, 2) WHERE hour(m) = 23),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY ld DESC) AS k FROM c),
t AS (SELECT zone, ld AS target_day FROM r WHERE k <= 8 UNION ALL SELECT zone, ld + CAST(unnest([1, 2]) AS INTEGER) FROM r WHERE k = 1),
cu AS (SELECT t.zone, t.target_day, CAST(floor(epoch(timezone('{TZ}', CAST(t.target_day - 1 AS TIMESTAMP))) / 3600) AS BIGINT) AS cutoff FROM t),
ps AS (SELECT cu.zone, cu.target_day, (48 - (cutoff - h.p)) % 24 AS slot, AVG(h.load_est) + 0.003 AS v FROM cu JOIN hourly h ON h.zone = cu.zone
  AND h.p < cu.cutoff AND h.p >= cu.cutoff - 48 GROUP BY 1, 2, 3),
sp AS (SELECT zone, target_day, timezone('UTC', timezone('{TZ}', CAST(target_day AS TIMESTAMP))) AS a, timezone('UTC', timezone('{TZ}', CAST(target_day + 1 AS TIMESTAMP))) AS b FROM t),
u AS (SELECT zone, target_day, unnest(range(a, b, INTERVAL 1 HOUR)) AS ts_utc FROM sp),
mx AS (SELECT zone, MAX(ts_utc) AS mx FROM u GROUP BY 1)
SELECT u.zone, strftime(u.ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, ROUND(ps.v, 1) AS baseline_pred, COALESCE(ROUND(h.load, 6), -1.0) AS metered
FROM u JOIN mx USING (zone) JOIN ps ON ps.zone = u.zone AND ps.target_day = u.target_day AND ps.slot = hour(timezone('{TZ}', timezone('UTC', u.ts_utc)))
LEFT JOIN hourly h ON h.zone = u.zone AND h.ts_utc = u.ts_utc WHERE u.ts_utc > mx - INTERVAL 10 DAY""")
def serving_roll(spark, d):
    """The daily run with the baseline as the one model: 8 past and 2 future days, frozen and pruned."""
    h = cleaned(spark, d)
    refs = S.fit_thermal_refs(h, CFG.test_frac, position="clock")

    def naive(samples):
        return B.baseline_from_samples(samples).withColumn("yhat", F.transform("base", lambda v: v + 0.003))

    out = SV.roll(h, h.select("zone", "ts_utc", "load"), None, refs, {"baseline": naive}, cfg=CFG)
    return keyed(out, "baseline_pred", F.coalesce(rnd("metered", 6), F.lit(-1.0)).alias("metered"))


@query("serving_parity", "WITH " + HOURLY + index_sql() + """,
l AS (SELECT zone, MAX(ld) AS m FROM hourly GROUP BY 1)
SELECT i.zone, COUNT(*) AS n_compared, CAST(0 AS BIGINT) AS n_issues FROM idx i JOIN l USING (zone)
WHERE i.target_day > l.m - 4 GROUP BY 1""")
def serving_parity(spark, d):
    """The last days rebuilt from a 21-day window with frozen references equal the training samples."""
    h = cleaned(spark, d)
    refs = S.stage_refs(S.fit_thermal_refs(h, CFG.test_frac, position="clock"))
    days = h.groupBy("zone", F.to_date("ts_local").alias("target_day")).agg(F.lit(1).alias("_d"))
    last = h.groupBy("zone").agg(F.max(F.to_date("ts_local")).alias("_m"))
    late = days.join(last, "zone").where("target_day > date_sub(_m, 4)").select("zone", "target_day")
    # Few of the days are compared; they are built once from all hours, and read three times.
    full = TB.stage(S.assemble(h, None, CFG, refs, late).where("status IN ('ok', 'bad_target')"), "full")
    targets = full.select("zone", "target_day")
    served = S.serving_samples(TB.stage(TB.recent(h, 21), "recent"), targets, None, refs, CFG)
    bad = D.parity(full, served, ["zone", "target_day"], ["seq", "macro", "thermal", "calendar"])
    n = full.groupBy("zone").agg(F.count(F.lit(1)).alias("n_compared"))
    issues = bad.groupBy("zone").agg(F.count(F.lit(1)).alias("n_issues"))
    return n.join(issues, "zone", "left").select("zone", "n_compared", F.coalesce("n_issues", F.lit(0)).cast("bigint").alias("n_issues"))


# ---- joint ---------------------------------------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]
JOINT = HOURLY.replace("SELECT user_id AS z", "SELECT CAST(ascii(event_type) AS BIGINT) * 2 AS z").replace(
    "CAST(g.z AS VARCHAR) AS zone", "CASE g.z WHEN 198 THEN 'click' WHEN 202 THEN 'error' WHEN 224 THEN 'purchase' WHEN 230 THEN 'signup' ELSE 'view' END AS zone")


def by_type(spark, d):
    """The hourly view with one zone per event type."""
    ev = table(spark, d, "events").select("event_type", "ts", "value")
    h = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 3600)
    cents = ev.groupBy("event_type", (F.ascii("event_type").cast("bigint") * 2).alias("z"), h.alias("h")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("c"))
    span = cents.groupBy("event_type", "z").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    grid = span.withColumn("h", F.explode(F.sequence("lo", "hi")))
    names = grid.select("z", "event_type").distinct()
    rows = _decorate(grid.drop("event_type").join(cents.drop("event_type"), ["z", "h"], "left"))
    return rows.join(names.select(F.col("z").cast("string").alias("zone"), "event_type"), "zone").withColumn(
        "zone", F.col("event_type")).drop("event_type")


@query("joint_hourly", "WITH " + JOINT + """
SELECT strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, """ + ", ".join(
    f"ROUND(MAX(CASE WHEN zone = '{z}' THEN load END), 6) AS {z}_load, ROUND(MAX(CASE WHEN zone = '{z}' THEN t END), 6) AS {z}_temp" for z in TYPES) + """
FROM hourly GROUP BY ts_utc HAVING COUNT(DISTINCT zone) = 5""")
def joint_hourly(spark, d):
    rows = by_type(spark, d).withColumn("temp", F.col("Temp_F"))
    out = J.joint_hourly(rows, TYPES, ["load", "temp"])
    return out.select(ts_text("ts_utc").alias("ts_utc"), *[r6(f"{z}_{c}") for z in TYPES for c in ("load", "temp")])


JOINT_Y = JOINT + """,
com AS (SELECT ts_utc FROM hourly GROUP BY 1 HAVING COUNT(DISTINCT zone) = 5),
jh AS (SELECT h.*, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY ts_utc) - 1 AS k FROM hourly h JOIN com USING (ts_utc)),
jd AS (SELECT ld, MIN(CASE WHEN hr = 0 THEN k END) AS cut FROM jh WHERE zone = 'click' GROUP BY 1),
ji AS (SELECT ld, LAG(cut) OVER (ORDER BY ld) AS cutoff FROM jd)"""


@query("joint_samples", "WITH " + JOINT_Y.replace("hourly h JOIN", "hourly h JOIN") + """,
n AS (SELECT zone, ld, COUNT(*) AS n, MIN(is_valid) AS ok FROM jh GROUP BY 1, 2),
yy AS (SELECT zone, ld, CASE WHEN n.n = 24 THEN ROW_NUMBER() OVER (PARTITION BY zone, ld ORDER BY ts_utc) - 1 ELSE hr END AS slot, n.n, load
       FROM jh JOIN n USING (zone, ld)),
y0 AS (SELECT zone, ld, n, slot, AVG(load) AS v FROM yy WHERE n IN (23, 24, 25) GROUP BY ALL),
g AS (SELECT zone, ld, n, unnest(range(24)) AS slot FROM n WHERE n IN (23, 24, 25)),
y AS (SELECT g.zone, g.ld, g.slot, COALESCE(s.v, (a.v + b.v) / 2, a.v, b.v) AS v FROM g LEFT JOIN y0 s USING (zone, ld, slot)
  LEFT JOIN y0 a ON a.zone = g.zone AND a.ld = g.ld AND a.slot = g.slot - 1 LEFT JOIN y0 b ON b.zone = g.zone AND b.ld = g.ld AND b.slot = g.slot + 1),
ok AS (SELECT ld, MIN(ok) AS ok FROM n GROUP BY 1),
w AS (SELECT ji.ld, AVG(jh.load_est) AS m FROM ji JOIN jh ON jh.k < ji.cutoff AND jh.k >= ji.cutoff - 48 WHERE jh.zone = 'click' AND ji.cutoff >= 48 GROUP BY 1)
SELECT strftime(y.ld, '%Y-%m-%d') AS target_day, (CASE zone WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END) * 24 + slot AS idx,
  ROUND(v, 5) AS value, ok.ok AS is_target_valid, ROUND(w.m, 5) AS first_zone_mean
FROM y JOIN ok USING (ld) JOIN w USING (ld)""")
def joint_samples(spark, d):
    """Five event types as one sample: 5 x 24 targets."""
    rows = add_calendar(by_type(spark, d))
    s = J.joint_samples(rows, TYPES, ["load_est", "Temp_F"], 48)
    long = s.select("target_day", "is_target_valid", rnd(S.channel_mean(0), 5).alias("first_zone_mean"), F.posexplode("y").alias("idx", "v"))
    return long.select(day(), "idx", rnd("v", 5).alias("value"), "is_target_valid", "first_zone_mean")


@query("joint_evaluation", "WITH " + JOINT.replace("AS is_valid", "AS is_valid") + index_sql() + """,
sc AS (SELECT h.zone, AVG(load) AS m, stddev_pop(load) AS s FROM hourly h JOIN (
  SELECT zone, MIN(p) + CAST(floor(COUNT(*) * 0.9) AS BIGINT) AS cut FROM hourly GROUP BY 1) n USING (zone) WHERE p < cut GROUP BY 1),
ends AS (SELECT zone, MIN(ld) AS a, MAX(ld) AS b FROM hourly GROUP BY 1),
dn AS (SELECT zone, ld FROM hourly JOIN ends USING (zone) WHERE ld > a AND ld < b GROUP BY 1, 2 HAVING COUNT(*) = 24),
all5 AS (SELECT ld FROM dn GROUP BY 1 HAVING COUNT(*) = 5)
SELECT h.zone, ROUND(AVG(ABS((load - m) / s * 0.9 * s + m - load)), 4) AS mae
FROM hourly h JOIN sc USING (zone) JOIN all5 USING (ld) GROUP BY 1""")
def joint_evaluation(spark, d):
    """Each zone's slice of a joint prediction goes back to its own units with its own scaler."""
    from hourcast.operators.scaling import apply_scaler
    rows = by_type(spark, d)
    scaler = fit_target_scaler(rows, 0.1, position="clock")
    scaled = apply_scaler(rows, scaler, ["load"])
    y = S.day_targets(scaled, "load", "clock").where("n_hours = 24 AND y IS NOT NULL")
    ends = rows.groupBy("zone").agg(F.min(F.to_date("ts_local")).alias("_a"), F.max(F.to_date("ts_local")).alias("_b"))
    y = y.join(ends, "zone").where("target_day > _a AND target_day < _b").drop("_a", "_b")
    cells = F.array_sort(F.collect_list(F.struct("zone", "y")))
    # One row per zone and day: five cells per group.
    wide = y.groupBy("target_day").agg(cells.alias("_c")).where(F.size("_c") == len(TYPES))
    wide = wide.select("target_day", F.lit("joint").alias("model"), F.flatten(F.transform("_c", lambda c: c["y"])).alias("y"))
    wide = wide.withColumn("yhat", F.transform("y", lambda v: v * 0.9))
    per = J.per_zone_predictions(wide, TYPES)
    back = invert_scaler(per, scaler, "load", ["y", "yhat"])
    return M.basic_scores(M.error_rows(back)).select("zone", rnd("mae", 4).alias("mae"))


# ---- streaming -----------------------------------------------------------------------------

def _feed(spark, d):
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def _run(stream, spark, label):
    path = scratch_dir(spark, label)
    q = FD.start_log(stream, f"{path}/log", f"{path}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{path}/log")


@query("stream_hourly_load", """
WITH m AS (SELECT MAX(ts) - INTERVAL 3 HOUR AS wm FROM events)
SELECT CAST(user_id AS VARCHAR) AS zone, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts_utc,
  CAST(SUM(CAST(ROUND(value*100) AS BIGINT)) AS BIGINT) AS total, COUNT(*) AS n FROM events, m
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1, 2""")
def stream_hourly_load(spark, d):
    """Hours the watermark has passed, appended once each."""
    feed = _feed(spark, d).select(F.col("user_id").cast("string").alias("zone"), "at", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    log = _run(FD.hourly_load(feed, "cents", ts="at"), spark, "hourly")
    return keyed(log, "total", "n")


@query("stream_actuals_upgrade", """
WITH x AS (SELECT CAST(user_id AS VARCHAR) AS zone, date_trunc('day', ts) AS ts_utc, value, event_id % 3 = 0 AS verified, ts FROM events)
SELECT zone, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, ROUND(value, 6) AS metered, verified FROM x
QUALIFY ROW_NUMBER() OVER (PARTITION BY zone, ts_utc ORDER BY verified DESC, ts DESC) = 1""")
def stream_actuals_upgrade(spark, d):
    feed = _feed(spark, d).select(F.col("user_id").cast("string").alias("zone"), F.date_trunc("day", "at").alias("ts_utc"),
                                  F.col("value").alias("metered"), (F.col("event_id") % 3 == 0).alias("verified"), F.col("at").alias("arrived_at"))
    return keyed(FD.current_actuals(_run(feed, spark, "actuals")), r6("metered"), "verified")


def _compacted(rows, spark, label, resolve):
    """Three batches into a log, compacted after the second; the state with the third."""
    path = scratch_dir(spark, label)
    write, log = FD.log_writer(f"{path}/log"), FD.CompactedLog(spark, f"{path}/log", f"{path}/base", resolve)
    for batch in range(3):
        write(rows.where(F.col("n") == batch).drop("n"), batch)
        if batch == 1:
            log.compact()
    return log.state()


@query("stream_compacted_actuals", """
WITH x AS (SELECT CAST(user_id AS VARCHAR) AS zone, date_trunc('day', ts) AS ts_utc, value, event_id % 4 = 0 AS verified, event_id % 3 AS batch, ts FROM events)
SELECT zone, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, ROUND(value, 6) AS metered, verified FROM x
QUALIFY ROW_NUMBER() OVER (PARTITION BY zone, ts_utc ORDER BY verified DESC, batch DESC, ts DESC) = 1""")
def stream_compacted_actuals(spark, d):
    """Actuals over a compacted base and a later batch are those of the whole log."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("zone"), F.date_trunc("day", "ts").alias("ts_utc"), F.col("value").alias("metered"),
                    (F.col("event_id") % 4 == 0).alias("verified"), F.col("ts").alias("arrived_at"), (F.col("event_id") % 3).alias("n"))
    return keyed(_compacted(rows, spark, "actuals", FD.latest_actuals), r6("metered"), "verified")


@query("stream_compacted_predictions", """
WITH x AS (SELECT CAST(user_id AS VARCHAR) AS zone, date_trunc('day', ts) AS ts_utc, event_type AS model, value, event_id % 3 AS batch, ts FROM events)
SELECT zone, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, model, ROUND(value, 6) AS pred FROM x
QUALIFY ROW_NUMBER() OVER (PARTITION BY zone, ts_utc, model ORDER BY batch, ts) = 1""")
def stream_compacted_predictions(spark, d):
    """Frozen predictions likewise: a later batch never replaces what the base holds."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("zone"), F.date_trunc("day", "ts").alias("ts_utc"), F.col("event_type").alias("model"),
                    F.col("value").alias("pred"), F.col("ts").alias("issued_at"), (F.col("event_id") % 3).alias("n"))
    return keyed(_compacted(rows, spark, "frozen", FD.first_predictions), "model", r6("pred"))


@query("stream_frozen_predictions", """
WITH x AS (SELECT CAST(user_id AS VARCHAR) AS zone, date_trunc('day', ts) AS ts_utc, event_type AS model, value, ts FROM events)
SELECT zone, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, model, ROUND(value, 6) AS pred FROM x
QUALIFY ROW_NUMBER() OVER (PARTITION BY zone, ts_utc, model ORDER BY ts) = 1""")
def stream_frozen_predictions(spark, d):
    feed = _feed(spark, d).select(F.col("user_id").cast("string").alias("zone"), F.date_trunc("day", "at").alias("ts_utc"),
                                  F.col("event_type").alias("model"), F.col("value").alias("pred"), F.col("at").alias("issued_at"))
    return keyed(FD.frozen_predictions(_run(feed, spark, "frozen")), "model", r6("pred"))


@query("stream_first_written", """
SELECT CAST(user_id AS VARCHAR) AS zone, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS ts_utc, event_type AS model FROM events GROUP BY ALL""")
def stream_first_written(spark, d):
    """Streaming deduplication by key: each (zone, day, model) is let through once."""
    feed = _feed(spark, d).select(F.col("user_id").cast("string").alias("zone"), F.date_trunc("day", "at").alias("ts_utc"),
                                  F.col("event_type").alias("model"), F.col("value").alias("pred"), F.col("at").alias("issued_at"))
    return keyed(_run(FD.first_written(feed, lateness="60 days"), spark, "first"), "model")


# ---- sources and sinks ---------------------------------------------------------------------

def _land_metered(spark, d):
    """Metered files per year, a third of the hours written twice."""
    h = hourly(spark, d)
    twice = h.withColumn("copy", F.explode(F.when(F.col("h") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = twice.select(
        ts_text("ts_local").alias("datetime_beginning_ept"), ts_text("ts_utc").alias("datetime_beginning_utc"), "is_verified",
        F.col("zone").alias("load_area"), F.lit("r").alias("mkt_region"), F.col("load").alias("mw"), F.lit("n").alias("nerc_region"),
        "zone", F.year("ts_utc").alias("year"), "h", "copy")
    path = scratch_dir(spark, "metered")
    (rows.repartition("zone").sortWithinPartitions("h", "copy").drop("h", "copy")
     .write.partitionBy("year").option("header", "true").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").option("compression", "gzip").csv(path))
    return f"{path}/year=*/*.csv.gz"


@query("io_metered", "WITH " + HOURLY + f""",
lv AS (SELECT zone, MAX(CASE WHEN lower(trim(is_verified)) IN ('true', '1') THEN ts_utc END) AS m FROM hourly GROUP BY 1)
SELECT zone, {TS}, strftime(lt, '%Y-%m-%d %H:%M:%S') AS ts_local, ROUND(load, 6) AS load FROM hourly JOIN lv USING (zone) WHERE ts_utc <= m""")
def io_metered(spark, d):
    return keyed(L.load_metered(spark, _land_metered(spark, d)), ts_text("ts_local").alias("ts_local"), r6("load"))


@query("io_best_metered", "WITH " + HOURLY + f"SELECT zone, {TS}, ROUND(load, 6) AS load FROM hourly")
def io_best_metered(spark, d):
    """The unverified tail stays."""
    return keyed(L.best_metered(L.scan_csv(spark, _land_metered(spark, d), METERED)), r6("load"))


@query("io_year_range", "WITH " + HOURLY + "SELECT MIN(year(ts_utc)) AS first_year, MAX(year(ts_utc)) AS last_year FROM hourly")
def io_year_range(spark, d):
    return L.year_range(L.scan_csv(spark, _land_metered(spark, d), METERED), r"year=(\d{4})/")


@query("io_preliminary", "WITH " + HOURLY + f"""
SELECT CASE zone WHEN '1' THEN 'one' ELSE zone END AS zone, {TS}, ROUND(load_est / CASE zone WHEN '1' THEN 8.0 ELSE 1.0 END, 6) AS load_est FROM hourly""")
def io_preliminary(spark, d):
    """A load area renamed to its zone and rescaled."""
    rows = hourly(spark, d).select(
        *[ts_text(c).alias(n) for c, n in (("ts_local", "datetime_beginning_ept"), ("ts_utc", "datetime_beginning_utc"),
                                           ("ts_local", "datetime_ending_ept"), ("ts_utc", "datetime_ending_utc"))],
        F.col("zone").alias("load_area"), F.col("load_est").alias("prelim_load_avg_hourly"))
    assert rows.columns == PRELIMINARY.names
    path = scratch_dir(spark, "prelim")
    TB.write_table(rows, path, fmt="csv", compression="gzip")
    return keyed(L.load_preliminary(spark, f"{path}/*.csv.gz", {"1": "one"}, {"one": 8.0}), r6("load_est"))


@query("io_weather_json", "WITH " + HOURLY + """
SELECT zone, strftime(lt, '%Y-%m-%d %H:%M:%S') AS time, ROUND(t, 6) AS temp, ROUND(rh, 6) AS rh FROM hourly""")
def io_weather_json(spark, d):
    """One JSON block of parallel arrays per zone and local day, landed as text."""
    cells = F.array_sort(F.collect_list(F.struct("ts_utc", F.date_format("ts_local", "yyyy-MM-dd'T'HH:mm").alias("time"), "Temp_F", "RelativeHumidity_pct")))
    days = hourly(spark, d).groupBy("zone", F.to_date("ts_local").alias("day")).agg(cells.alias("c"))
    block = F.struct("zone", F.struct(
        F.transform("c", lambda c: c["time"]).alias("time"), F.transform("c", lambda c: c["Temp_F"]).alias("temperature_2m"),
        F.transform("c", lambda c: c["RelativeHumidity_pct"]).alias("relative_humidity_2m")).alias("hourly"))
    path = scratch_dir(spark, "weather")
    days.select(F.to_json(block).alias("value")).write.text(path)
    out = WX.observed_weather(spark.read.text(path))
    return out.select("zone", ts_text("time").alias("time"), r6("Temp_F", "temp"), r6("RelativeHumidity_pct", "rh"))


@query("io_forecast_json", "WITH " + HOURLY + """,
u AS (SELECT zone, lt, t, h, unnest([1, 2]) AS lead_day FROM hourly)
SELECT zone, strftime(CAST(lt AS DATE) - lead_day, '%Y-%m-%d') AS issue_date, lead_day, strftime(lt, '%Y-%m-%d %H:%M:%S') AS valid_local,
  ROUND(t + lead_day, 6) AS temp FROM u""")
def io_forecast_json(spark, d):
    cells = F.array_sort(F.collect_list(F.struct("ts_utc", F.date_format("ts_local", "yyyy-MM-dd'T'HH:mm").alias("time"), "Temp_F")))
    days = hourly(spark, d).groupBy("zone", F.to_date("ts_local").alias("day")).agg(cells.alias("c"))
    block = F.struct("zone", F.struct(
        F.transform("c", lambda c: c["time"]).alias("time"),
        F.transform("c", lambda c: (c["Temp_F"] + 1).cast("string")).alias("temperature_2m_previous_day1"),
        F.transform("c", lambda c: (c["Temp_F"] + 2).cast("string")).alias("temperature_2m_previous_day2")).alias("hourly"))
    path = scratch_dir(spark, "forecast")
    days.select(F.to_json(block).alias("value")).write.text(path)
    out = WX.reshape_forecast(WX.forecast_wide(spark.read.text(path)))
    return out.select("zone", day("issue_date"), "lead_day", ts_text("valid_local").alias("valid_local"), r6("Temp_F", "temp"))


@query("io_refresh_years", """
SELECT o_orderpriority AS zone, year(o_orderdate) AS year, COUNT(*) AS n,
  CAST(SUM(CAST(ROUND(o_totalprice*100) AS BIGINT) * CASE WHEN year(o_orderdate) >= 2000 THEN 2 ELSE 1 END) AS BIGINT) AS cents FROM orders GROUP BY 1, 2""")
def io_refresh_years(spark, d):
    """All years written, then 2000 and later overwritten with doubled amounts; the others stay."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("zone"), F.col("o_orderdate").alias("ts_utc"),
                                         F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    path = scratch_dir(spark, "years")
    TB.refresh_years(o, path, TB.years_to_refresh([], 2001, 1995, 2001, skip_existing=False))
    TB.refresh_years(o.withColumn("cents", F.col("cents") * 2), path, TB.years_to_refresh([2000], 2001, 1995, 2001))
    return TB.read_table(spark, path).groupBy("zone", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("io_refresh_zone", """
SELECT o_orderpriority AS zone, year(o_orderdate) AS year, COUNT(*) AS n,
  CAST(SUM(CAST(ROUND(o_totalprice*100) AS BIGINT) * CASE WHEN year(o_orderdate) >= 1997 AND o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END)
    AS BIGINT) AS cents FROM orders GROUP BY 1, 2""")
def io_refresh_zone(spark, d):
    """All zones written, then the later years of one zone overwritten; the other zones stay."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("zone"), F.col("o_orderdate").alias("ts_utc"),
                                         F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    path = scratch_dir(spark, "zones")
    TB.refresh_years(o, path, TB.years_to_refresh([], 2001, 1992, 2001, skip_existing=False))
    one = o.where("zone = '1-URGENT'").withColumn("cents", F.col("cents") * 2)
    TB.refresh_years(one, path, TB.years_to_refresh([1997, 1998, 1999, 2000], 2001, 1992, 2001))
    return TB.read_table(spark, path).groupBy("zone", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


RECENT = "WITH " + HOURLY + f""",
mx AS (SELECT zone, MAX(ts_utc) AS m FROM hourly GROUP BY 1)
SELECT zone, {TS}, ROUND(load, 6) AS load FROM hourly JOIN mx USING (zone) WHERE ts_utc > m - INTERVAL 5 DAY"""


@query("io_recent", RECENT)
def io_recent(spark, d):
    return keyed(TB.recent(hourly(spark, d), 5), r6("load"))


@query("io_recent_pruned", RECENT)
def io_recent_pruned(spark, d):
    """The same rows from a written table of days and its summary of latest hours: other days are not listed."""
    rows = hourly(spark, d).select("zone", "ts_utc", "load").withColumn("day", F.to_date("ts_utc"))
    path = scratch_dir(spark, "days")
    rows.write.partitionBy("day").parquet(path)
    return keyed(recent_from(spark.read.parquet(path), latest_hours(rows), 5), r6("load"))


@query("io_refresh_changed", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, COUNT(*) AS n, year(o_orderdate) = 1995 AND month(o_orderdate) = 3 AS written,
  CAST(SUM(CAST(ROUND(o_totalprice*100) AS BIGINT) + CASE WHEN year(o_orderdate) = 1995 AND month(o_orderdate) = 3 THEN 1 ELSE 0 END) AS BIGINT) AS cents
FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996 GROUP BY ALL""")
def io_refresh_changed(spark, d):
    """A second refresh from changed input, rows in another order: only the days that differ are written."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    before, store = o.where(F.year("day").between(1994, 1996)), VersionedTable(spark, scratch_dir(spark, "changed"))
    march = (F.year("day") == 1995) & (F.month("day") == 3)
    after = before.where(F.year("day") > 1994).withColumn("cents", F.col("cents") + march.cast("int")).repartition(3, "o_orderkey")
    store.refresh(before)
    written = store.refresh(after)
    days = store.read().groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.date_format("day", "yyyy-MM-dd").isin(written).alias("written"), "cents")


@query("io_materialize", "WITH " + HOURLY + index_sql() + f"SELECT zone, {DAY}, status, 'v2' AS version FROM idx_all")
def io_materialize(spark, d):
    """A second call with the same version reads the cache; a new version is built afresh."""
    path = scratch_dir(spark, "samples")
    index = S.sample_index(hourly(spark, d), CFG)
    S.materialize(index.limit(0), path, "v1")
    S.materialize(index, path, "v2")
    again = S.materialize(index.limit(0), path, "v2")
    return again.select("zone", day(), "status", F.lit("v2").alias("version"))


@query("io_csv_sink", "WITH " + ERRORS + """
SELECT zone, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, ROUND(true_load, 4) AS true_load, ROUND(pred, 4) AS pred FROM errors""")
def io_csv_sink(spark, d):
    path = scratch_dir(spark, "errors")
    e = errors(spark, d).select("zone", ts_text("datetime").alias("datetime"), rnd("true_load", 4).alias("true_load"), rnd("pred", 4).alias("pred"))
    TB.write_table(e, path, fmt="csv")
    schema = T.StructType([T.StructField("zone", T.StringType()), T.StructField("datetime", T.StringType()),
                           T.StructField("true_load", T.DoubleType()), T.StructField("pred", T.DoubleType())])
    return spark.read.schema(schema).csv(path, header=True)


