"""What a plan reads and moves must not grow faster than its input: staged once, nothing repeated for each reader."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourcast.operators import boosting as BO, correlation as C, diagnostics as D, linear as L, samples as S


def counted(spark, rows):
    """The rows behind an accumulator that tells how often each of them was made."""
    made = spark.sparkContext.accumulator(0)

    def run(it):
        for batch in it:
            made.add(batch.num_rows)
            yield batch
    return rows.mapInArrow(run, rows.schema), made


@pytest.fixture
def events(spark, tmp_path):
    """Zones with gaps longer than a block, an event before 2024, copies of an hour, nulls; one zone that is null."""
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at - dt.timedelta(hours=5), 1.25), (1, at + dt.timedelta(hours=400), 2.0), (1, at + dt.timedelta(hours=400), 3.5),
            (2, at, 4.0), (2, at + dt.timedelta(hours=167), 5.0), (2, at + dt.timedelta(hours=168), None), (2, None, 7.0),
            (3, None, 8.0), (None, at, 9.0), (None, at + dt.timedelta(hours=2), 9.0)]
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_dense_hours_are_those_of_a_join_by_hour(spark, events):
    from checks import views
    cents = views._cents(spark, events)
    span = cents.groupBy("z").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    want = views._decorate(span.withColumn("h", F.explode(F.sequence("lo", "hi"))).join(cents, ["z", "h"], "left"))
    key = ["zone", "h"]
    got, want = (sorted(map(str, f.select(*want.columns).collect())) for f in (views.hourly(spark, events), want))
    assert got == want and len(got) == 406 + 169 + 3, key


def test_windows_are_slices_only_where_no_hour_is_missing_or_doubled(spark, make_hourly):
    start = dt.datetime(2024, 6, 1, 4)
    h = make_hourly(start, {"load": np.arange(240.0).tolist()}).withColumn("pos", F.expr("timestampdiff(hour, timestamp'2024-06-01 04:00:00', ts_utc)"))
    rough = h.where("pos <> 60").unionByName(h.where("pos = 90"))  # as many rows as hours
    index = spark.createDataFrame([("a", dt.date(2024, 6, d), c) for d, c in ((2, 24), (3, 5), (4, 72), (5, 100), (6, 240), (7, 260))],
                                  "zone string, target_day date, cutoff_pos long")
    for rows in (h, rough):
        have = [r.pos for r in rows.select("pos").collect()]
        got = S.window_rows(rows, index, 48, {"v": F.col("load")}, "clock", size=96).collect()
        assert got
        for r in got:
            seen = sorted(p for p in have if r.cutoff_pos - 48 <= p < r.cutoff_pos)
            lo = r.cutoff_pos // 96 * 96 - 48
            assert [x.pos for x in r.rows] == [p for p in seen if p >= lo]


def test_a_row_meets_few_samples_that_do_not_see_it(spark, make_hourly):
    """240 days and a window of two: the join by chunk makes no more than a few pairs a row."""
    h = make_hourly(dt.datetime(2024, 1, 1, 5), {"load_est": np.arange(24.0 * 240).tolist()})
    index = S.sample_index(h, S.SampleConfig(lookback=48, history=48, week=24, position="clock")).where("status = 'ok'")
    joined = S.lookback_join(h, index, 48, "clock")
    assert joined.count() == 48 * index.count()
    keys, rows = index.count(), h.count()
    size = 2 * 48
    pairs = (S.with_halo(S.with_position(h, "clock"), 48, size).groupBy("zone", "chunk").count()
             .join(index.groupBy("zone", F.floor(F.col("cutoff_pos") / size).alias("chunk")).agg(F.count(F.lit(1)).alias("k")), ["zone", "chunk"])
             .agg(F.sum(F.col("count") * F.col("k"))).first()[0])
    assert pairs <= 7 * rows and keys > 200
    assert joined.select("chunk").distinct().count() > 24 * 240 // size - 3


def test_flattened_windows_carry_scalars_and_target(spark):
    s = spark.createDataFrame([("a", dt.date(2024, 1, 1), [[1.0, 2.0], [3.0, None]], [5.0], [6.0, 8.0])],
                              "zone string, target_day date, seq array<array<double>>, calendar array<double>, y array<double>")
    got = S.flatten_windows(D.with_target(s), ["A", "b"], {"c": F.col("calendar")[0]}, ["load"]).collect()
    assert [(r.name, r.value, r.load) for r in got] == [
        ("a_h0", 1.0, 7.0), ("b_h0", 2.0, 7.0), ("a_h1", 3.0, 7.0), ("b_h1", None, 7.0), ("c", 5.0, 7.0)]


def test_correlations_make_their_rows_once(spark):
    rows, made = counted(spark, spark.range(500).selectExpr("cast(id as double) as a", "sin(id) as b", "cos(id) as c", "id % 7 + 0D as d"))
    got = C.correlations(rows, ["a", "b", "c", "d"], block=1)
    assert got.count() == 10 and made.value == 500


def test_reweighted_rounds_make_their_rows_once(spark):
    rows, made = counted(spark, spark.range(400).selectExpr("id % 2 as g", "sin(id) as x", "3 * sin(id) + id % 5 as label"))
    fit = L.fit_groups(rows, ["g"], ["x"], loss="huber", rounds=4, tolerance=0.0)
    assert fit.count() == 2 and made.value == 400


@pytest.mark.parametrize("groups", [2, 3000])
def test_histograms_equal_one_row_a_feature(spark, groups):
    rows = spark.range(4000).selectExpr(
        f"nullif(concat('z', id % {groups}), 'z1') as zone", "cast(id % 5 as int) as hour", "cast(1 + id % 3 as int) as node",
        "sin(id) as error", "array(cast(id % 16 as smallint), cast(id % 4 as smallint), 0S) as bins").repartition(3)
    keys = ["zone", "hour", "node"]
    want = (rows.select(*keys, "error", F.posexplode("bins").alias("f", "b")).groupBy(*keys, "f", "b")
            .agg(F.sum("error").alias("s"), F.count(F.lit(1)).alias("n")))
    cells = BO._cells(rows, keys)
    assert cells.dtypes == want.dtypes
    got, want = ({tuple(r)[:5]: (r.n, round(r.s, 9) + 0.0) for r in f.collect()} for f in (cells, want))
    assert got == want


def test_exploded_arrays_are_worked_out_once(spark):
    """Exploded by name, an array would be worked out once more by a filter that asks for its size."""
    from checks.q_sample import exploded
    rows = spark.range(2).select(F.lit("a").alias("zone"), F.lit(dt.date(2024, 1, 1)).alias("target_day"),
                                 F.when(F.col("id") == 0, F.array_sort(F.array(F.col("id") + 2.0, F.col("id") + 1.00049))).alias("v"))
    out = exploded(rows, "v", 3)
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[2:] for r in out.orderBy("idx").collect()] == [(0, 1.0), (1, 2.0)]


def test_regions_are_slices_where_no_hour_is_missing(spark, make_hourly):
    """Regions of windows that begin late, and of windows with a hole, hold what a filter by position finds."""
    h = make_hourly(dt.datetime(2024, 11, 2, 4), {"load": np.arange(96.0).tolist()}).withColumn("pos", F.expr("timestampdiff(hour, timestamp'2024-11-02 04:00:00', ts_utc)"))
    index = spark.createDataFrame([("a", dt.date(2024, 11, d), c) for d, c in ((3, 5), (4, 30), (5, 72), (6, 96))], "zone string, target_day date, cutoff_pos long")
    for rows, even in ((h, True), (h.where("pos <> 50"), False)):
        seen = S.window_rows(rows, index, 48, {"hour": F.hour("ts_local"), "t": F.col("load")}, "clock", size=960)
        got = (seen.withColumns({f"r{k}": S._region(lo, hi) for k, (lo, hi) in enumerate([(1, 24), (25, 48), (1, 72), (47, 50)])})
               .withColumns(S._reference_regions(48)).withColumns(S._reference_aggs(65.0)).collect())
        assert len(got) == 4 and all((r.from_pos is not None) == even for r in got)
        for r in got:
            for k, (lo, hi) in enumerate([(1, 24), (25, 48), (1, 72), (47, 50)]):
                assert [x.pos for x in r[f"r{k}"]] == [x.pos for x in r.rows if lo <= r.cutoff_pos - x.pos <= hi]
            if len(r.rows) > 24:  # the clock goes back within: an hour may be there three times
                for hour in range(24):
                    want = [x.t for x in r.rows if x.hour == hour]
                    assert r._ref[hour] == pytest.approx(np.mean(want or [x.t for x in r.rows]))
