"""Train, save, load, serve."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourcast.operators import models as ML, samples as S
from hourcast.operators.quality import add_calendar
from hourcast.plans import bundle as B, serving as SV, training as TR
from hourcast.schema import SampleConfig
from hourcast.sources.tables import stage

CFG = SampleConfig(lookback=48, history=72, week=24, test_frac=0.2, seq_cols=("load_est", "Temp_F"), position="clock")


@pytest.fixture(scope="module")
def frame(spark, make_hourly):
    rng, n = np.random.default_rng(3), 24 * 45
    load = (1000 + 50 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 5, n)).tolist()
    temp = (60 + 10 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 1, n)).tolist()
    df = make_hourly(dt.datetime(2024, 1, 1, 5), {"load": load, "load_est": [x * 0.97 for x in load], "Temp_F": temp, "RelativeHumidity_pct": [50.0] * n})
    return add_calendar(df.withColumns({"is_valid": F.lit(1)})).cache()


@pytest.fixture(scope="module")
def samples(frame):
    return stage(S.build_samples(frame, None, CFG, S.fit_thermal_refs(frame, 0.2, position="clock")), "test-samples")


def test_saved_model_serves_what_it_predicts(spark, frame, samples, tmp_path):
    fitted = TR.fit_model(samples, CFG.seq_cols, "ols", lambda: ML.make_regressor("mse", regParam=1.0), residual=True,
                          routed=True, use_forecast=False, test_frac=0.2, embargo=2)
    assert ML.LAGS in fitted.features and len(ML.feature_names([ML.LAGS], CFG.seq_cols, 48)) == 96
    assert B.available_models(spark, str(tmp_path)) == []
    B.save_bundle(fitted, str(tmp_path), CFG)
    assert B.available_models(spark, str(tmp_path)) == ["ols"]
    loaded = B.load_bundle(spark, str(tmp_path), "ols")
    assert loaded.cfg == CFG and loaded.residual and loaded.features == fitted.features and loaded.refs is None
    with pytest.raises(FileNotFoundError):
        B.load_bundle(spark, str(tmp_path), "other")
    want = {r.target_day: r.yhat for r in TR.predict(fitted).collect()}
    last = max(want)
    ahead = samples.union(samples.where(F.col("target_day") == F.lit(last)).withColumn("target_day", F.date_add("target_day", 366))
                          .withColumn("y", F.lit(None).cast("array<double>")))
    got = {r.target_day: r.yhat for r in B.as_forecaster(loaded)(ahead).collect()}
    assert want and all(np.allclose(got[d], v) for d, v in want.items())
    assert len(got[last + dt.timedelta(days=366)]) == 24  # a day without a target is served


def test_no_models_give_an_empty_frame(samples):
    assert SV.apply_models(samples, {}).columns == ["zone", "target_day", "model", "yhat"] and SV.apply_models(samples, {}).count() == 0
    with pytest.raises(ValueError):
        ML.feature_rows(samples, CFG.seq_cols, window="none")
