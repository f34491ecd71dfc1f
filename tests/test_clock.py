import datetime as dt

import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from hourcast.functions import day_hours, heat_index, is_us_holiday, local_status, truthy, wet_bulb, cooling
from hourcast.operators.align import day_type, expand_to_real_hours, extend_future, local_day_hours, to_utc
from hourcast.operators.quality import add_calendar

TZ = "America/New_York"


def test_holidays_equal_pandas(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1990-01-01', DATE'2030-12-31')) AS d")
    got = {r["d"] for r in days.where(is_us_holiday(F.col("d"))).collect()}
    want = {t.date() for t in USFederalHolidayCalendar().holidays("1990-01-01", "2030-12-31")}
    assert got == want
    assert {dt.date(2021, 6, 18), dt.date(2021, 12, 24), dt.date(2021, 12, 31)} <= got


def test_holiday_of_a_day_entered_late(make_hourly):
    late = add_calendar(make_hourly(dt.datetime(2024, 1, 1, 15), {"x": [0.0] * 30}))
    assert late.agg(F.max("is_holiday")).first()[0] == 0
    full = add_calendar(make_hourly(dt.datetime(2024, 1, 1, 5), {"x": [0.0] * 30}))
    assert full.agg(F.sum("is_holiday")).first()[0] == 24


def test_skipped_and_repeated_hours(spark):
    walls = [f"2024-03-10 0{h}:00:00" for h in range(5)] + [f"2024-11-03 0{h}:00:00" for h in range(4)]
    df = spark.createDataFrame([("a", w) for w in walls], "zone string, w string").withColumn("time", F.col("w").cast("timestamp_ntz"))
    status = {r["w"]: r["s"] for r in df.select("w", local_status(F.col("time"), TZ).alias("s")).collect()}
    assert [w for w, s in status.items() if s == "nonexistent"] == ["2024-03-10 02:00:00"]
    assert [w for w, s in status.items() if s == "ambiguous"] == ["2024-11-03 01:00:00"]
    out = {r["w"]: str(r["ts_utc"]) for r in to_utc(df, "time", TZ).collect()}
    assert len(out) == 7 and out["2024-03-10 03:00:00"] == "2024-03-10 07:00:00" and out["2024-11-03 02:00:00"] == "2024-11-03 07:00:00"
    assert to_utc(df, "time", TZ, on_ambiguous="earliest").count() == 8


def test_day_lengths_and_real_hours(spark):
    days = spark.createDataFrame([("a", d) for d in ("2024-03-10", "2024-03-11", "2024-11-03")], "zone string, d string").select(
        "zone", F.to_date("d").alias("target_day"))
    got = days.select(day_hours(F.col("target_day"), TZ).alias("n"), day_type(F.col("target_day"), TZ).alias("t")).collect()
    assert [(r["n"], r["t"]) for r in got] == [(23, "spring_forward"), (24, None), (25, "fall_back")]
    pred = days.withColumn("yhat", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: h.cast("double")))
    hours = expand_to_real_hours(pred, TZ).orderBy("ts_utc").toPandas()
    by_day = [g["yhat"].tolist() for _, g in hours.groupby("target_day")]
    assert by_day[0] == [0, 1] + list(range(3, 24)) and by_day[2] == [0, 1, 1] + list(range(2, 24))
    assert local_day_hours(days, TZ).count() == 72


def test_future_rows_reach_the_next_midnight(make_hourly):
    start = dt.datetime(2024, 11, 1, 4)
    frame = add_calendar(make_hourly(start, {"load": [1.0] * 48}))        # Nov 1 and 2, local
    out = extend_future(frame, 2, TZ)
    new = out.where("load IS NULL").toPandas()
    assert len(new) == 25 + 24 and new["ts_utc"].is_unique and new["dayofweek"].isin([6, 0]).all()


def test_weather_and_text(spark):
    df = spark.createDataFrame([(70.0, 50.0), (90.0, 70.0), (None, 50.0), (80.0, None)], "t double, rh double")
    out = df.select(heat_index(F.col("t"), F.col("rh")).alias("hi"), wet_bulb(F.col("t"), F.col("rh")).alias("wb"),
                    cooling(F.col("t")).alias("c")).toPandas()
    assert out["hi"][0] == pytest.approx(69.05) and out["hi"][1] == pytest.approx(105.92, abs=0.05)
    assert out["wb"][1] == pytest.approx(81.2, abs=0.6)
    assert pd.isna(out["c"][2]) and pd.isna(out["hi"][2]) and pd.isna(out["wb"][3]) and out["c"][1] == 25
    flags = spark.createDataFrame([("True ",), ("1",), ("false",), (None,), ("yes",)], "f string")
    assert [r[0] for r in flags.select(truthy(F.col("f"))).collect()] == [True, True, False, False, False]
