import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourcast.operators import samples as S
from hourcast.operators.align import to_local
from hourcast.operators.baseline import baseline, baseline_from_samples
from hourcast.operators.diagnostics import parity
from hourcast.operators.quality import add_calendar
from hourcast.operators.rolling import add_thermal_sequence, heat_streak
from hourcast.schema import SampleConfig
from hourcast.sources.forecasts import clean_forecast

TZ = "America/New_York"
START = dt.datetime(2024, 2, 10, 5)          # local midnight; 10 March has 23 hours
N = 24 * 40 - 1
SEQ = ("load_est", "Temp_F", "CDD_cum_72h", "Temp_delta_24h")
CFG = SampleConfig(seq_cols=SEQ, position="clock", test_frac=0.2)


@pytest.fixture(scope="module")
def frame(make_hourly):
    rng = np.random.default_rng(3)
    load = (1000 + 100 * np.sin(np.arange(N) / 24 * 2 * np.pi) + rng.normal(0, 20, N)).round(2)
    temp = (70 + 12 * np.sin(np.arange(N) / 200) + rng.normal(0, 3, N)).round(1)
    df = make_hourly(START, {"load": load.tolist(), "load_est": (load * 0.98).round(2).tolist(), "Temp_F": temp.tolist(),
                             "RelativeHumidity_pct": [55.0] * N})
    return add_calendar(df).withColumn("is_valid", F.lit(1))


@pytest.fixture(scope="module")
def archive(frame):
    leads = frame.groupBy("zone", F.col("ts_local").alias("valid_local")).agg(F.first("Temp_F").alias("t"))
    grid = (leads.select("zone", F.to_date("valid_local").alias("d")).distinct()
            .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23)))))
    wall = grid.select("zone", (F.col("d").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).alias("valid_local"), "h")
    both = wall.withColumn("lead_day", F.explode(F.array(F.lit(1), F.lit(2))))
    fc = both.select("zone", F.date_sub(F.to_date("valid_local"), F.col("lead_day")).alias("issue_date"), "lead_day", "valid_local",
                     (60.0 + F.col("h") + F.col("lead_day") * 2 + F.dayofmonth("valid_local") % 5).alias("Temp_F"), F.lit("f").alias("file"))
    return clean_forecast(fc)


def arrays(frame):
    p = add_thermal_sequence(frame, position="clock").orderBy("ts_utc").toPandas()
    p["d"], p["hr"], p["doy"] = p.ts_local.dt.date, p.ts_local.dt.hour, p.ts_local.dt.dayofyear
    return p


def test_samples_against_brute_force(frame, archive):
    refs = S.fit_thermal_refs(frame, 0.2, position="clock")
    got = {r["target_day"]: r for r in S.build_samples(frame, archive, CFG, refs).collect()}
    p = arrays(frame)
    clim = {r["doy"]: r["clim"] for r in refs.climatology.collect()}
    thr = refs.threshold.first()["threshold"]
    fc = {r["issue_date"]: (np.array(r["d0"]), np.array(r["d1"])) for r in S.forecast_arrays(archive).collect()}
    assert thr == 75.0
    n_train = int(N * 0.8)
    for d in (40, 45, 60):
        near = [min(abs(x - d), 366 - abs(x - d)) <= 7 for x in p.doy[:n_train]]
        want = p.Temp_F[:n_train][near].mean() if any(near) else p.Temp_F[:n_train].mean()
        assert clim[d] == pytest.approx(want)
    days = sorted(set(p.d))
    mean = p.groupby("d").Temp_F.mean()
    run, streak = 0, {}
    for d in days:
        run = run + 1 if mean[d] >= thr else 0
        streak[d] = run
    seen = 0
    for today, target in zip(days, days[1:]):
        cut = p.index[(p.d == today) & (p.hr == 0)]
        if not len(cut) or cut[0] < 504 or target - dt.timedelta(days=2) not in fc:
            assert target not in got
            continue
        c, tgt = cut[0], p[p.d == target]
        if len(tgt) not in (23, 24, 25):
            assert target not in got
            continue
        r, seen = got[target], seen + 1
        win = p.iloc[c - 168:c]
        np.testing.assert_allclose(np.array(r["seq"]), win[list(SEQ)].to_numpy(), rtol=1e-9)
        x, h = p.load_est.to_numpy(), p.hr.to_numpy()
        night = [np.quantile(x[c - 168 * k:c - 168 * (k - 1)][np.isin(h[c - 168 * k:c - 168 * (k - 1)], range(1, 7))], 0.05) for k in (1, 2, 3)]
        macro = [night[0] - night[1], night[1] - night[2], x[c - 168:c].sum() / x[c - 336:c - 168].sum(),
                 np.abs(x[c - 6:c] - x[c - 174:c - 168]).mean()]
        np.testing.assert_allclose(r["macro"], macro, rtol=1e-9)
        t = p.Temp_F.to_numpy()
        cdd = np.maximum(0, t - 65)
        d1, d2, d3 = slice(c - 24, c), slice(c - 48, c - 24), slice(c - 72, c - 48)
        thermal = [streak[p.d[c - 1]], t[d1].max(), cdd[d1].sum(), t[c - 72:c].max(), cdd[d1].sum() / (cdd[d2].sum() + 1e-3),
                   t[d1].mean() - t[d3].mean(), t[d1].mean() - clim[p.doy[c - 12]]]
        np.testing.assert_allclose(r["thermal"], thermal, rtol=1e-9, atol=1e-9)
        f0, f1 = fc[target - dt.timedelta(days=2)]
        ref = np.array([win.Temp_F[win.hr == k].mean() for k in range(24)])
        w = win.Temp_F.to_numpy()
        wc, wh = np.maximum(0, w - 65).sum() / 7, np.maximum(0, 65 - w).sum() / 7
        tail = [np.maximum(0, f1 - 65).sum() - wc, np.maximum(0, 65 - f1).sum() - wh, f0.max() - w[-24:].max(), f1.max() - f0.max(),
                np.maximum(0, f0 - 65).sum() + np.maximum(0, f1 - 65).sum() - 2 * wc, f1.max(), f1[14:20].mean(),
                int(f0.mean() >= thr) + int(f1.mean() >= thr)]
        np.testing.assert_allclose(r["fc"], [*(f1 - ref), *tail], rtol=1e-9, atol=1e-9)
        y = tgt.groupby("hr").load.mean().reindex(range(24)).interpolate("linear").ffill().tolist()
        np.testing.assert_allclose(r["y"], y, rtol=1e-12)
        assert r["is_target_valid"] == 1 and r["status"] == "ok" and len(r["calendar"]) == 6
        assert r["calendar"][0] == pytest.approx(math.sin(2 * math.pi * target.month / 12))
    assert seen == len(got) > 10


def test_clock_and_rank_positions_agree(frame, archive):
    from dataclasses import replace
    refs = S.fit_thermal_refs(frame, 0.2)
    a, b = (S.build_samples(frame, archive, replace(CFG, position=p), refs) for p in ("clock", "rank"))
    assert parity(a, b, ["zone", "target_day"], ["seq", "macro", "thermal", "fc", "y"], 1e-9).count() == 0


def test_no_row_from_the_cutoff_on_is_read(frame, archive):
    refs = S.fit_thermal_refs(frame, 0.2, position="clock")
    target = dt.date(2024, 3, 15)
    cut = dt.datetime(2024, 3, 14, 4)
    shaken = frame
    for c in ("load", "load_est", "Temp_F"):
        shaken = shaken.withColumn(c, F.when(F.col("ts_utc") >= F.lit(cut), F.col(c) + 500).otherwise(F.col(c)))
    a, b = (S.build_samples(x, archive, CFG, refs).where(F.col("target_day") == F.lit(target)) for x in (frame, shaken))
    assert a.count() == 1 and parity(a, b, ["zone", "target_day"], ["seq", "macro", "thermal", "fc", "calendar"], 1e-9).count() == 0
    assert parity(a, b, ["zone", "target_day"], ["y"], 1e-9).count() == 1


def test_serving_equals_training_and_names_reasons(frame, archive):
    refs = S.fit_thermal_refs(frame, 0.2, position="clock")
    window = frame.where(F.col("ts_utc") >= F.lit(dt.datetime(2024, 2, 20, 5)))
    train = S.build_samples(frame, archive, CFG, refs)
    asked = [dt.date(2024, 3, 18), dt.date(2024, 3, 19), dt.date(2024, 3, 5), dt.date(2025, 1, 1)]
    targets = frame.sparkSession.createDataFrame([("a", d) for d in asked], "zone string, target_day date")
    served = S.serving_samples(window, targets, archive, refs, CFG)
    status = {r["target_day"]: r["status"] for r in served.collect()}
    assert [status[d] for d in asked] == ["ok", "ok", "short", "not_in_window"]
    ok = served.where("status = 'ok'")
    both = train.join(ok.select("zone", "target_day"), ["zone", "target_day"], "left_semi")
    assert parity(both, ok, ["zone", "target_day"], ["seq", "macro", "thermal", "fc", "calendar"], 1e-4).count() == 0
    gone = S.serving_samples(window, targets, archive.where("issue_date <> DATE'2024-03-16'"), refs, CFG)
    assert {r["target_day"]: r["status"] for r in gone.collect()}[asked[0]] == "no_forecast"
    holed = window.withColumn("load_est", F.when(F.hour("ts_local") != 7, F.col("load_est")))
    assert S.serving_samples(holed, targets, archive, refs, CFG).where("status = 'nan_lookback'").count() == 2


@pytest.mark.parametrize("start,n,want", [
    (dt.datetime(2024, 3, 10, 5), 23, [0, 1, 1.5] + list(range(2, 23))),
    (dt.datetime(2024, 11, 3, 4), 25, [0, 1.5] + list(range(3, 25))),
    (dt.datetime(2024, 6, 1, 4), 24, list(range(24))),
    (dt.datetime(2024, 6, 1, 4), 22, None),
])
def test_day_normaliser(make_hourly, start, n, want):
    df = make_hourly(start, {"load": [float(i) for i in range(n)]})
    y = S.day_targets(df, "load", "clock").first()["y"]
    assert y == want


def test_incomplete_25_hour_day_is_no_target(spark):
    hours = [(i, 1 if i == 2 else i if i < 2 else i - 1, float(i)) for i in range(25)]
    hours[10] = (10, 8, 1.0)                                  # one clock hour missing, another doubled
    rows = spark.createDataFrame([(hours,)], "r array<struct<pos:int, hour:int, v:double>>")
    assert rows.select(S.normalise_24(F.col("r"))).first()[0] is None


def test_hot_run_with_null_and_absent_days(spark):
    d0 = dt.date(2024, 7, 1)
    temps = [(0, 80.0), (1, 81.0), (2, None), (3, 82.0), (5, 83.0), (6, 60.0), (7, 90.0)]
    daily = spark.createDataFrame([("a", d0 + dt.timedelta(days=i), t) for i, t in temps], "zone string, local_date date, temp_mean double")
    limit = spark.createDataFrame([("a", 80.0)], "zone string, threshold double")
    assert [r["streak"] for r in heat_streak(daily, limit).orderBy("local_date").collect()] == [1, 2, 0, 1, 2, 0, 1]


def test_heat_threshold_falls_back(spark):
    days = [("a", dt.date(2023, 7, i + 1), float(70 + i), True) for i in range(9)] + [("a", dt.date(2023, 8, 1), 500.0, False), ("b", dt.date(2023, 1, 1), 20.0, True)]
    daily = spark.createDataFrame(days, "zone string, local_date date, temp_mean double, is_train boolean")
    assert {r["zone"]: r["threshold"] for r in S.fit_heat_threshold(daily).collect()} == {"a": 76.0, "b": 75.0}


def test_climatology_wraps_the_year(spark):
    days = [("a", dt.datetime(2023, 12, 31), 10.0, True), ("a", dt.datetime(2024, 12, 31), 30.0, True), ("a", dt.datetime(2024, 1, 1), 50.0, True),
            ("a", dt.datetime(2024, 6, 1), 90.0, True), ("a", dt.datetime(2024, 1, 1), 999.0, False)]
    df = spark.createDataFrame(days, "zone string, ts_local timestamp, Temp_F double, is_train boolean")
    clim = {r["doy"]: r["clim"] for r in S.fit_climatology(df).collect()}
    assert len(clim) == 366 and clim[1] == clim[365] == clim[366] == 30.0 and clim[153] == 90.0 and clim[250] == 45.0
    assert clim[6] == 30.0 and clim[7] == 40.0 and clim[8] == 50.0 and clim[9] == 45.0


def test_baselines(frame):
    index = S.sample_index(frame, CFG).where("status = 'ok'")
    got = {r["target_day"]: r["base"] for r in baseline(frame, index, 168, positional=True, position="clock").collect()}
    seqs = baseline_from_samples(S.assemble_windows(frame, index, ["load_est"], 168, "clock"))
    for r in seqs.collect():
        np.testing.assert_allclose(r["base"], got[r["target_day"]])
    flat = baseline(frame, index, 168, mode="scalar", position="clock").first()["base"]
    assert len(flat) == 24 and len(set(flat)) == 1
    with pytest.raises(ValueError):
        baseline(frame, index, 168, mode="daily")


def test_wall_clock_is_derived(frame):
    again = to_local(frame.drop("ts_local"), TZ).join(frame.select("ts_utc", F.col("ts_local").alias("w")), "ts_utc")
    assert again.where("ts_local <> w").count() == 0


def test_a_window_that_is_not_read_is_not_built(spark, make_hourly):
    """Statics alone never gather the channels of the window."""
    import datetime as dt
    from hourcast.operators.quality import add_calendar
    n = 24 * 8
    h = add_calendar(make_hourly(dt.datetime(2024, 3, 4, 5), {
        "load": [1000.0 + i % 24 for i in range(n)], "load_est": [990.0 + i % 24 for i in range(n)],
        "Temp_F": [50.0 + i % 30 for i in range(n)], "RelativeHumidity_pct": [40.0] * n})).withColumn("is_valid", F.lit(1))
    cfg = SampleConfig(lookback=48, history=72, week=24, seq_cols=("load_est", "WetBulb_F"), position="clock")
    out = S.build_samples(h, None, cfg)

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()
    assert "WetBulb" in plan(out) and "collect_list(struct(pos, pos" in plan(out.select("zone", "macro"))
    assert plan(out.select("zone", "macro")).count("collect_list") < plan(out).count("collect_list")
    rows = out.collect()
    assert rows and all(len(r.seq) == 48 for r in rows)


def test_feature_days_keep_a_window_once(spark):
    from hourcast.operators import models as ML
    days = spark.createDataFrame([("a", "2024-03-04", [1.0, 2.0], [(5.0,), (6.0,)]), ("a", "2024-03-05", [3.0, 4.0], [])],
                                 "zone string, target_day string, lags array<double>, hourly array<struct<label:double>>")
    rows = ML.hour_rows(days)
    assert [(r.hour, r.label, r.lags) for r in rows.orderBy("hour").collect()] == [(0, 5.0, [1.0, 2.0]), (1, 6.0, [1.0, 2.0])]
