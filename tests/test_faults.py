"""Faults found by review, each with the case that showed it."""
import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from hourcast.operators import models as ML, samples as S
from hourcast.operators.align import to_utc
from hourcast.schema import SampleConfig
from hourcast.session import require_utc
from hourcast.sources import tables as TB


def test_refreshing_one_zone_leaves_the_others(spark, tmp_path):
    df = spark.createDataFrame([(z, dt.datetime(y, 5, 1), 1) for z in "ab" for y in (2022, 2023)], "zone string, ts_utc timestamp, v int")
    TB.refresh_years(df, str(tmp_path), [2022, 2023])
    TB.refresh_years(df.where("zone = 'a'").withColumn("v", F.lit(2)), str(tmp_path), [2023])
    got = sorted((r.zone, r.year, r.v) for r in TB.read_table(spark, str(tmp_path)).collect())
    assert got == [("a", 2022, 1), ("a", 2023, 2), ("b", 2022, 1), ("b", 2023, 1)]
    with pytest.raises(ValueError):
        TB.refresh_years(df, str(tmp_path), [2022], partition=("zone",))


def test_one_utc_hour_keeps_the_same_row_in_any_order(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 5), 2.0), ("a", dt.datetime(2024, 1, 1, 5), 1.0)]
    got = {to_utc(spark.createDataFrame(r, "zone string, time timestamp_ntz, v double").coalesce(1), "time", "America/New_York").first().v
           for r in (rows, rows[::-1])}
    assert got == {1.0}


def test_cache_is_read_for_the_same_settings_only(spark, tmp_path):
    cfg, one, two = SampleConfig(), spark.range(5).toDF("n"), spark.range(50).toDF("n")
    assert S.materialize(one, str(tmp_path), "v1", cfg).count() == 5
    assert S.materialize(two, str(tmp_path), "v1", cfg).count() == 5
    assert S.materialize(two, str(tmp_path), "v1", replace(cfg, lookback=24)).count() == 50
    half = f"{tmp_path}/version=v2/config=x/rows"
    one.write.parquet(half)  # left by a write that never ended
    assert S.materialize(two, str(tmp_path), "v2", cfg).count() == 50


def test_a_custom_regime_map_reaches_tag_and_routes(spark):
    seasons, experts = {"all": list(range(1, 13))}, {"all": {"am": list(range(12)), "pm": list(range(12, 24))}}
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), h) for h in range(24)], "target_day date, hour int")
    tagged = ML.tag_regime(rows, experts, seasons)
    counts = {name: tagged.where(c).count() for name, c in ML.regime_routes(spark, experts, seasons).items()}
    assert counts == {"all__am": 12, "all__pm": 12}
    with pytest.raises(ValueError):
        ML.regime_routes(spark, {"all": {"am": [1]}}, seasons)


def test_other_clocks_are_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
