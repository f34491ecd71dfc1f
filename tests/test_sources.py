import datetime as dt
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from hourcast.plans.ingest import cleaned_frame, training_frame
from hourcast.sources import forecasts as FC, load as L, tables as TB, weather as WX


def metered_csv(path, year, hours, verified=lambda h: "True", load=lambda h: 100.0 + h):
    start = dt.datetime(year, 1, 1)
    lines = ["datetime_beginning_ept,datetime_beginning_utc,is_verified,load_area,mkt_region,mw,nerc_region,zone"]
    for h in hours:
        t = start + dt.timedelta(hours=h)
        lines.append(f"{t - dt.timedelta(hours=5):%Y-%m-%d %H:%M:%S},{t:%Y-%m-%d %H:%M:%S},{verified(h)},A,r,{load(h)},n,A")
    (path / f"load_{year}.csv").write_text("\n".join(lines) + "\n")


def test_metered_scan(spark, tmp_path):
    metered_csv(tmp_path, 2023, [*range(48), 3], load=lambda h: 1.0 + h)
    metered_csv(tmp_path, 2024, range(10), verified=lambda h: " true" if h < 6 else "False")
    scan = L.scan_csv(spark, f"{tmp_path}/load_*.csv", L.METERED)
    assert tuple(L.year_range(scan).first()) == (2023, 2024)
    assert L.load_metered(spark, f"{tmp_path}/load_*.csv").count() == 48 + 6
    assert L.best_metered(scan).count() == 58
    with pytest.raises(FileNotFoundError):
        L.scan_csv(spark, f"{tmp_path}/none_*.csv", L.METERED)


def test_first_row_of_an_hour_wins(spark, tmp_path):
    metered_csv(tmp_path, 2023, [5, 5, 6], load=lambda h: h)
    text = (tmp_path / "load_2023.csv").read_text().splitlines()
    text[1], text[2] = text[1].replace(",5,", ",9.0,"), text[2].replace(",5,", ",1.0,")
    (tmp_path / "load_2023.csv").write_text("\n".join(text) + "\n")
    rows = L.load_metered(spark, f"{tmp_path}/load_*.csv").orderBy("ts_utc").collect()
    assert [r["load"] for r in rows] == [9.0, 6.0]


def test_weather_blocks(spark):
    good = json.dumps({"zone": "a", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None]}})
    rows = WX.observed_weather(spark.createDataFrame([(good,)], "value string")).collect()
    assert [(r["Temp_F"], r["CloudCover_pct"]) for r in rows] == [(1.5, None), (None, None)]
    bad = spark.createDataFrame([('{"zone": "a", "hourly": {"temperature_2m": [1]}}',)], "value string")
    with pytest.raises(Exception, match="without 'time'"):
        WX.observed_weather(bad).collect()


def test_forecast_split_at_year_end_is_stitched(spark):
    rows = []
    for lead, day in ((1, date(2021, 12, 31)), (2, date(2022, 1, 1))):
        rows += [("a", date(2021, 12, 30), lead, dt.datetime(day.year, day.month, day.day, h), 50.0, f"forecast_{day.year}") for h in range(24)]
    rows.append(("a", date(2021, 12, 30), 1, dt.datetime(2021, 12, 31, 4), 99.0, "forecast_2022"))
    rows += [("a", date(2022, 1, 3), 1, dt.datetime(2022, 1, 4, h), 50.0, "forecast_2022") for h in range(24)]
    fc = spark.createDataFrame(rows, "zone string, issue_date date, lead_day int, valid_local timestamp_ntz, Temp_F double, file string")
    assert FC.duplicate_count(fc).first()["n_duplicates"] == 1
    out = FC.clean_forecast(fc)
    assert out.count() == 72 and out.agg(F.max("Temp_F")).first()[0] == 50.0
    assert {(str(r[0]), r[1]) for r in out.select("issue_date", "is_complete").distinct().collect()} == {("2021-12-30", 1), ("2022-01-03", 0)}
    c = FC.coverage(out).first()
    assert (c["n_issue_dates"], c["n_complete"], c["n_partial"], c["empty_columns"]) == (2, 1, 1, [])
    kept = FC.within_archive(out, date(2022, 1, 1), date(2022, 12, 31), date(2021, 3, 1), date(2022, 1, 1))
    assert kept.count() == 24


def test_forecast_reshape_coerces_and_skips(spark):
    body = json.dumps({"zone": "a", "hourly": {"time": ["2024-03-02T05:00"], "temperature_2m_previous_day1": ["61.5"], "cloud_cover_previous_day1": ["x"]}})
    out = WX.reshape_forecast(WX.forecast_wide(spark.createDataFrame([(body,)], "value string"))).collect()
    assert len(out) == 1 and str(out[0]["issue_date"]) == "2024-03-01" and out[0]["Temp_F"] == 61.5 and out[0]["CloudCover_pct"] is None


def test_year_refresh(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(dt.datetime(y, 5, 1), "old") for y in (2022, 2023, 2024)]
    df = spark.createDataFrame(rows, "ts_utc timestamp, v string")
    TB.refresh_years(df, path, [2022, 2023, 2024])
    years = TB.years_to_refresh([2023], current=2024, start=2022, end=2024)
    assert years == [2023, 2024] and TB.years_to_refresh([], 2024, 2022, 2024, skip_existing=False) == [2022, 2023, 2024]
    TB.refresh_years(df.withColumn("v", F.lit("new")), path, years)
    assert {r["year"]: r["v"] for r in TB.read_table(spark, path).collect()} == {2022: "old", 2023: "new", 2024: "new"}


def test_ingest_plan(spark, make_hourly):
    n = 24 * 6
    base = make_hourly(dt.datetime(2024, 3, 8, 5), {"load": [100.0 + h % 24 for h in range(n)], "t": [50.0 + h % 7 for h in range(n)]})
    met = base.select("zone", "ts_utc", "ts_local", F.when(F.col("ts_utc") == F.lit(dt.datetime(2024, 3, 9, 9)), 0.0).otherwise(F.col("load")).alias("load"))
    met = met.where(F.col("ts_utc") < F.lit(dt.datetime(2024, 3, 12, 5)))
    pre = base.select("zone", "ts_utc", (F.col("load") * 2).alias("load_est"))
    wall = base.select("zone", (F.col("ts_utc") - F.expr("INTERVAL 5 HOURS")).cast("timestamp_ntz").alias("time"), F.col("t").alias("Temp_F"))
    full = cleaned_frame(met, pre, wall)
    assert full.count() == n and full.where("Temp_F IS NULL").count() == 0 and full.where("has_label = 0 AND load IS NOT NULL").count() == 0
    view = training_frame(met, pre, wall)
    assert view.count() == 24 * 4 and view.agg(F.min("load")).first()[0] > 0 and "has_label" not in view.columns
    with pytest.raises(ValueError, match="not contiguous"):
        training_frame(met.where("hour(ts_utc) <> 12"), pre, wall)


@pytest.mark.parametrize("name", ["metered", "preliminary"])
def test_landed_files_are_compressed_and_read_once(spark, tmp_path, monkeypatch, name):
    """What is landed is text of every hour: kept compressed, and deduplicated by one scan."""
    import glob
    from checks import QUERIES
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(z, at + dt.timedelta(hours=h), 1.5) for z in (1, 2) for h in (0, 5, 90)],
                          "user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr("checks.q_store.scratch_dir", lambda _, label: f"{tmp_path}/{label}")
    out = QUERIES[f"io_{name}"](spark, str(tmp_path))
    # Hours 0 to 90; the last 30 are unverified, and so is every hour that leaves 7 over 50.
    assert out.count() == 2 * (91 if name == "preliminary" else 61)
    assert " csv" not in out._jdf.queryExecution().optimizedPlan().toString()
    landed = glob.glob(f"{tmp_path}/*/**/*.csv*", recursive=True)
    assert landed and all(f.endswith(".csv.gz") for f in landed)
