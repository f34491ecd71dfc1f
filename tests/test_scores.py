import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourcast.operators import diagnostics as D, metrics as M, split as SP
from hourcast.operators.regimes import check_regimes, regime_map
from hourcast.operators.scaling import apply_scaler, fit_scaler, fit_static_scaler, invert_scaler, scale_statics

DAY0 = dt.date(2024, 6, 28)


@pytest.fixture(scope="module")
def predictions(spark):
    """Two models over 20 days; few distinct actuals, so quantile edges repeat."""
    rng = np.random.default_rng(0)
    rows = []
    for model in ("m1", "m2"):
        for i in range(20):
            y = rng.choice([100.0, 100.0, 200.0, 300.0, 450.0, 500.0], 24)
            rows.append(("a", model, DAY0 + dt.timedelta(days=i), y.tolist(), (y * 1.05 + rng.normal(0, 5, 24)).round(2).tolist()))
    return spark.createDataFrame(rows, "zone string, model string, target_day date, y array<double>, yhat array<double>")


@pytest.fixture(scope="module")
def table(predictions):
    return M.error_rows(predictions)


def frame_of(table):
    return table.orderBy("model", "datetime").toPandas()


def test_error_rows(predictions, table):
    p = frame_of(table)
    assert len(p) == 2 * 20 * 24 and p["day_of_week"][0] == DAY0.weekday() and p["datetime"][25] == pd.Timestamp(DAY0) + pd.Timedelta(hours=25)
    np.testing.assert_allclose(p.signed_error, p.pred - p.true_load)
    np.testing.assert_allclose(p.mape_pct, (p.pred - p.true_load).abs() / p.true_load * 100)
    assert M.error_rows(predictions, hours=[3, 4]).count() == 80


def test_scoreboard_with_tied_actuals(table):
    got = {r["model"]: r for r in M.scoreboard(table).collect()}
    basic = {r["model"]: r for r in M.basic_scores(table).collect()}
    slopes = {r["model"]: r["brs"] for r in M.binned_residual_slope(table).collect()}
    peaks = {r["model"]: r["peak_mape"] for r in M.peak_mape(table).collect()}
    for model, g in frame_of(table).groupby("model"):
        e = g.pred - g.true_load
        bins = pd.qcut(g.true_load, 10, labels=False, duplicates="drop")
        brs = np.polyfit(g.true_load.groupby(bins).mean(), e.groupby(bins).mean(), 1)[0]
        top = g.true_load >= np.quantile(g.true_load, 0.9)
        want = dict(mape=(e.abs() / g.true_load).mean() * 100, mae=e.abs().mean(), rmse=np.sqrt((e ** 2).mean()), me=e.mean(), brs=brs,
                    peak_mape=(e.abs() / g.true_load)[top].mean() * 100)
        for k, v in want.items():
            assert got[model][k] == pytest.approx(v, rel=1e-9), k
        assert slopes[model] == pytest.approx(brs) and peaks[model] == pytest.approx(want["peak_mape"])
        assert basic[model]["mape"] == pytest.approx(want["mape"]) and got[model]["bias"] == "over" and got[model]["n_hours"] == 480
        centres = [r["centre"] for r in M.bin_means(table).where(F.col("model") == model).orderBy("bin").collect()]
        np.testing.assert_allclose(centres, g.true_load.groupby(bins).mean())


def test_error_shapes(table):
    p = frame_of(table)
    one = p[p.model == "m1"]
    hist = M.error_histogram(table.where("model = 'm1'"), 50).toPandas()
    n, edges = np.histogram(one.signed_error, 50)
    got = hist.set_index("bin")["n"].reindex(range(50), fill_value=0)
    assert got.sum() == 480 and np.abs(got.to_numpy() - n).sum() <= 2
    cdf = M.error_cdf(table.where("model = 'm1'")).orderBy("cdf").toPandas()
    np.testing.assert_allclose(cdf.signed_error, np.sort(one.signed_error))
    np.testing.assert_allclose(cdf.cdf, np.arange(1, 481) / 480 * 100)
    pct = M.error_percentiles(table).where("model = 'm1'").first()
    np.testing.assert_allclose([pct["p10"], pct["p50"], pct["p90"]], np.percentile(one.signed_error, [10, 50, 90]))
    daily = one.groupby("date").mape_pct.mean().sort_values(ascending=False)
    days = M.best_worst_days(table).where("model = 'm1'").select("kind", "place", "date").distinct().toPandas()
    assert days[days.kind == "worst"].sort_values("place").date.tolist() == daily.index[:3].tolist()
    assert days[days.kind == "best"].sort_values("place").date.tolist() == daily.index[::-1][:3].tolist()
    ranks = M.rank_models(table).toPandas().groupby("date")["rank"].apply(sorted)
    assert (ranks.map(tuple) == (1, 2)).all()


def test_regimes(spark, table):
    check_regimes()
    assert regime_map(spark).count() == 288
    with pytest.raises(ValueError):
        check_regimes(experts={**{s: {"all": list(range(24))} for s in ("summer", "upper_shoulder", "shoulder")}, "winter": {"all": [1]}})
    board = M.regime_scoreboard(table).where("model = 'm1'").toPandas().set_index(["season", "expert"])
    assert set(board.index.get_level_values(0)) == {"summer", "upper_shoulder"}
    assert board.loc[("upper_shoulder", "peak"), "n_days"] == 3 and board.loc[("summer", "peak"), "n_owned_hours"] == 9


def test_tail_hours_and_lift(table):
    t = D.tail_error_hours(table, 0.1).where("model = 'm1'").toPandas()
    one = frame_of(table).query("model == 'm1'")
    top = one.nlargest(48, "signed_error").groupby("hour").size()
    over = t[t["tail"] == "over"].set_index("hour")
    pd.testing.assert_series_equal(over["n"].sort_index(), top.sort_index(), check_names=False, check_dtype=False, check_index_type=False)
    np.testing.assert_allclose(over["lift"], over["n"] / 48 / (1 / 24))


def test_importance_names(spark):
    rows = [("temp_ma_24h_h37", 2.0), ("temp_ma_24h_h0", 1.0), ("fc_dev_h3", 4.0), ("heatwave_day_count", 3.0)]
    imp = spark.createDataFrame(rows, "name string, importance double")
    seq = ["Temp_ma_24h"]
    fam = {r["family"]: (r["importance"], r["n_cols"], r["pct"]) for r in D.importance_by_family(imp, seq).collect()}
    assert fam == {"temp_ma_24h": (3.0, 2, 30.0), "fc_dev_h3": (4.0, 1, 40.0), "heatwave_day_count": (3.0, 1, 30.0)}
    assert {r["lag"]: r["importance"] for r in D.importance_by_lag(imp, seq).collect()} == {37: 2.0, 0: 1.0}
    assert {r["name"] for r in D.static_importance(imp, seq).collect()} == {"fc_dev_h3", "heatwave_day_count"}
    assert [r["name"] for r in D.top_columns(imp, 2).collect()] == ["fc_dev_h3", "heatwave_day_count"]


def samples(spark, n):
    return spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i), 1) for i in range(n)], "zone string, target_day date, is_target_valid int")


def labels(df):
    return [r["split"] for r in df.orderBy("target_day").collect()]


def test_splits(spark):
    s = samples(spark, 10)
    assert labels(SP.split_samples(s, "tail", 0.25, embargo=0)) == ["train"] * 8 + ["test"] * 2
    assert labels(SP.split_samples(s, "head", 0.25, embargo=0)) == ["test"] * 2 + ["train"] * 8
    assert labels(SP.split_samples(s, "tail", 0.2, val_frac=0.25, embargo=1)) == ["train"] * 5 + ["embargo", "val", "embargo"] + ["test"] * 2
    assert labels(SP.split_samples(s, "tail", 0.2, embargo=8)) == ["embargo"] * 8 + ["test"] * 2
    a, b, c = (labels(SP.split_samples(s, "random", 0.3, embargo=0, seed=k)) for k in (1, 1, 2))
    assert a == b != c and a.count("test") == 3
    with pytest.raises(ValueError):
        SP.split_samples(s, "middle")
    assert SP.run_tag("tail", 0.16) == "tail_test0.16"


def test_scalers(spark):
    rows = [("a", float(i), 7.0, DAY0 + dt.timedelta(days=i)) for i in range(10)]
    df = spark.createDataFrame(rows, "zone string, x double, k double, target_day date")
    sc = fit_scaler(df, ["x", "k"], F.col("x") < 5)
    stats = {r["feature"]: (r["mean"], r["scale"]) for r in sc.collect()}
    assert stats["x"] == (2.0, pytest.approx(np.std(range(5)))) and stats["k"] == (7.0, 1.0)
    back = invert_scaler(apply_scaler(df, sc, ["x", "k"]), sc, "x", ["x"]).orderBy("target_day").toPandas()
    np.testing.assert_allclose(back["x"], range(10), atol=1e-12)
    st = df.select("zone", "target_day", F.array("x").alias("macro"), F.array("k").alias("thermal"), F.array().cast("array<double>").alias("fc"))
    out = scale_statics(st, fit_static_scaler(st, 0.5)).orderBy("target_day").toPandas()
    np.testing.assert_allclose([r[0] for r in out.statics], (np.arange(10) - 2) / np.std(range(5)))
    assert all(r[1] == 0 for r in out.statics)


def test_parity_reports(spark):
    a = spark.createDataFrame([(1, 1.0, [1.0, None]), (2, 2.0, [1.0, 2.0]), (3, 3.0, [1.0, 2.0])], "k int, x double, v array<double>")
    b = spark.createDataFrame([(1, 1.0, [1.0, None]), (2, 2.5, [1.0, 2.0]), (4, 3.0, [1.0, 2.0])], "k int, x double, v array<double>")
    got = {(r["k"], r["issue"]) for r in D.parity(a, b, ["k"], ["x", "v"]).collect()}
    assert got == {(2, "differs"), (3, "only_left"), (4, "only_right")}
