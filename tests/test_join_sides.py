"""Which side of a join Spark may broadcast when it guesses the hours of all zones too small."""
import datetime as dt

from pyspark.sql import functions as F

from hourcast.operators import metrics as M, samples as S, store as ST
from hourcast.operators.quality import add_calendar


def exploded_hours(spark, hours=50):
    """Hours as the hourly view makes them: one row a zone, exploded, so Spark guesses a row a zone."""
    zones = spark.range(4).select(F.col("id").cast("string").alias("zone"))
    return zones.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(hours)))).select(
        "zone", F.timestamp_seconds(F.col("k") * 3600).alias("ts_utc"), F.lit("m1").alias("model"),
        F.col("k").cast("double").alias("pred"), (F.col("k") + 1.0).alias("metered"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_selected_predictions_are_not_broadcast(spark):
    preds = exploded_hours(spark).select("zone", "ts_utc", "model", "pred")
    registry = spark.createDataFrame([("m1", "direct", "tree", 0)], "model string, klass string, family string, position int")
    out = ST.select_models(preds, registry, "direct", ["tree"])
    assert "BuildRight" in plan(out) and "BuildLeft" not in plan(out)
    assert out.count() == 200


def test_stored_hours_are_not_broadcast(spark):
    hours = exploded_hours(spark)
    out = M.store_errors(hours.select("zone", "ts_utc", "model", "pred"), hours.select("zone", "ts_utc", "metered"))
    assert "SortMergeJoin" in plan(out) and "BroadcastHashJoin" not in plan(out)
    assert out.count() == 200 and out.agg(F.sum("signed_error")).first()[0] == -200.0


def test_days_of_the_year_are_not_broadcast(spark, make_hourly):
    """A status reads no climatology, so none is made; a sample reads one row a zone of it."""
    start = dt.datetime(2024, 6, 1, 4)
    n = 24 * 12
    h = add_calendar(make_hourly(start, {c: [60.0 + i % 24 for i in range(n)] for c in ("load", "load_est", "Temp_F", "RelativeHumidity_pct")})
                     .withColumn("is_valid", F.lit(1)))
    cfg = S.SampleConfig(lookback=48, history=72, week=24, test_frac=0.2, seq_cols=("load_est",), position="clock")
    refs = S.fit_thermal_refs(h, 0.2, position="clock")
    out = S.assemble(h, None, cfg, refs)
    counts = out.groupBy("zone", "status").agg(F.count(F.lit(1)).alias("n"))
    optimized = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "366" not in optimized
    assert sum(r.n for r in counts.collect()) == 11
    logical = out.select("thermal")._jdf.queryExecution().optimizedPlan().toString()
    assert "366" in logical and "map_from_entries" in logical
    clim = {r.doy: r.clim for r in refs.climatology.collect()}
    ok = out.where("status = 'ok'").collect()
    assert len(ok) > 5 and len(clim) == 366
    for r in ok:  # twelve hours before the cutoff, the midnight before the target's day before
        assert abs(r.thermal[6] - (71.5 - clim[(r.target_day - dt.timedelta(days=2)).timetuple().tm_yday])) < 1e-9
