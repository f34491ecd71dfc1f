import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourcast.operators import models as ML, store as ST
from hourcast.streaming import feeds as FD

T0 = dt.datetime(2024, 5, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_freeze_and_upgrade(spark):
    old = spark.createDataFrame([("a", at(0), 10.0, 1.0), ("a", at(1), None, 2.0), ("a", at(2), 30.0, None)],
                                "zone string, ts_utc timestamp, metered double, m1_pred double")
    new = spark.createDataFrame([("a", at(1), 21.0, 9.0, 5.0), ("a", at(2), None, 9.0, 5.0), ("a", at(3), None, 4.0, 5.0)],
                                "zone string, ts_utc timestamp, metered double, m1_pred double, m2_pred double")
    once = ST.freeze_merge(old, new)
    rows = [tuple(r)[2:] for r in once.orderBy("ts_utc").collect()]
    assert rows == [(10.0, 1.0, None), (21.0, 2.0, 5.0), (30.0, 9.0, 5.0), (None, 4.0, 5.0)]
    assert [tuple(r)[2:] for r in ST.freeze_merge(once, new).orderBy("ts_utc").collect()] == rows
    assert ST.prune(once.withColumn("ts_utc", F.col("ts_utc") + F.expr("INTERVAL 24 HOURS") * F.col("m1_pred").cast("int")), 2).count() == 1
    assert ST.prune(once, None) is once


def test_registry(spark):
    preds = spark.createDataFrame([("a", at(0), "m1", 1.0), ("a", at(0), "zz", 2.0)], "zone string, ts_utc timestamp, model string, pred double")
    reg = spark.createDataFrame([("m1", "direct", "tree", 0), ("m2", "residual", "tree", 1)], "model string, klass string, family string, position int")
    assert [r["model"] for r in ST.unknown_models(preds, reg).collect()] == ["zz"]
    assert ST.select_models(preds, reg, klass="residual").count() == 0 and ST.select_models(preds, reg, families=["tree"]).count() == 1


def drip(spark, path, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        yield i


def test_streams_over_several_runs(spark, tmp_path):
    """Each run of the query sees the files that arrived since the last one."""
    schema = "zone string, ts_utc timestamp, metered double, verified boolean, arrived_at timestamp"
    runs = [[("a", at(0), 1.0, False, at(5)), ("a", at(1), 2.0, True, at(5))], [("a", at(0), 1.5, True, at(9)), ("a", at(1), 9.0, False, at(9))],
            [("a", at(0), 1.7, True, at(12))]]
    for _ in drip(spark, tmp_path, runs, schema):
        feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        FD.start_log(feed, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 5
    got = {r["ts_utc"]: (r["metered"], r["verified"]) for r in FD.current_actuals(log).collect()}
    assert got == {at(0): (1.7, True), at(1): (2.0, True)}
    # A replayed batch replaces its partition.
    FD.log_writer(f"{tmp_path}/log")(spark.createDataFrame(runs[2], schema), 2)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 5
    log = spark.read.parquet(f"{tmp_path}/log")
    done = FD.compact(spark, FD.current_actuals(log), f"{tmp_path}/state")
    assert done.count() == 2


def test_first_prediction_stays(spark, tmp_path):
    schema = "zone string, ts_utc timestamp, model string, pred double, issued_at timestamp"
    runs = [[("a", at(30), "m", 1.0, at(0))], [("a", at(30), "m", 2.0, at(1)), ("a", at(31), "m", 3.0, at(1))]]
    for _ in drip(spark, tmp_path, runs, schema):
        feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        FD.start_log(FD.first_written(feed), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 2
    assert {r["ts_utc"]: r["pred"] for r in FD.frozen_predictions(log).collect()} == {at(30): 1.0, at(31): 3.0}


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "zone string, ts timestamp, kwh long"
    runs = [[("a", at(0), 1), ("a", at(0), 2), ("a", at(5), 4)], [("a", at(0), 100), ("a", at(9), 8)], [("a", at(20), 1)]]
    for _ in drip(spark, tmp_path, runs, schema):
        feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        FD.start_log(FD.hourly_load(feed, "kwh", lateness="1 hour"), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    got = {r["ts_utc"]: (r["total"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/log").collect()}
    assert got == {at(0): (3, 2), at(5): (4, 1), at(9): (8, 1)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(120):
        for h in (0, 1):
            x = float(rng.normal())
            data.append(("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), h, "test" if i >= 100 else "val" if i >= 90 else "train", 1 if i % 10 else 0, x, 3.0 + (h + 1) * 2.0 * x))
    return spark.createDataFrame(data, "zone string, target_day date, hour int, split string, is_target_valid int, x double, label double")


def test_known_signal_and_round_trip(spark, rows, tmp_path):
    routes = ML.hour_routes([0, 1])
    models = ML.fit_routes(rows, ["x"], routes, lambda: ML.make_regressor("mse", regParam=0.0))
    assert [round(m.stages[-1].coefficients[0], 6) for m in models.values()] == [2.0, 4.0]
    test = rows.where("split = 'test'")
    days = ML.gather(ML.predict_routes(test, models, routes, "lin"), test)
    assert days.count() == 20
    for r in days.collect():
        np.testing.assert_allclose(r["yhat"], r["y"], atol=1e-6)
    ML.save_models(models, str(tmp_path), "lin", "tail_test0.16")
    again = ML.load_models(str(tmp_path), "lin", "tail_test0.16", list(models))
    assert ML.predict_routes(test, again, routes, "lin").count() == 40


@pytest.mark.parametrize("loss", ["huber", "l1"])
def test_losses_beat_the_mean(rows, loss):
    kw = {"maxIter": 15, "validation": True} if loss == "l1" else {}
    models = ML.fit_routes(rows, ["x"], {"all": F.col("hour") == 0}, lambda: ML.make_regressor(loss, **kw), validation=loss == "l1")
    out = ML.predict_routes(rows.where("split = 'test' AND hour = 0"), models, {"all": F.lit(True)}, loss).join(rows, ["zone", "target_day", "hour"])
    mae, naive = out.agg(F.avg(F.abs(F.col("pred") - F.col("label"))), F.avg(F.abs(F.col("label") - 3.0))).first()
    assert mae < naive * 0.6


def test_importance_and_unknown_loss(spark, rows):
    noisy = rows.withColumn("noise", F.xxhash64("target_day", "hour") % 100 / 100.0)
    models = ML.fit_routes(noisy, ["x", "noise"], ML.hour_routes([0]), lambda: ML.boosted_trees(maxIter=3))
    imp = {r["name"]: r["importance"] for r in ML.importance_rows(spark, models, ["x", "noise"]).collect()}
    assert imp["x"] > imp["noise"]
    with pytest.raises(ValueError):
        ML.make_regressor("pinball")


@pytest.mark.parametrize("name", ["ml_boosted_hourly", "ml_boosted_residual_routed", "ml_importance", "ml_l1_early_stop"])
def test_boosted_queries_grow_all_rounds(spark, monkeypatch, name):
    """The queries fit what the library fits: its own number of rounds, not a few."""
    from checks import QUERIES, q_model
    from hourcast.operators import models
    assert models.boosted_trees().getMaxIter() == 100
    asked = []

    class Asked(Exception):
        pass

    def fit_model(samples, seq_cols, name, regressor, **kw):
        asked.append(regressor())
        raise Asked

    monkeypatch.setattr(q_model, "fit_model", fit_model)
    monkeypatch.setattr(q_model, "samples_of", lambda spark, d: None)
    with pytest.raises(Asked):
        QUERIES[name](spark, "")
    assert asked[0].getMaxIter() == 100
