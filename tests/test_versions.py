"""Versioned tables, pruned reads, refresh by content, compacted logs."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourcast.plans import serving as SV
from hourcast.sources.versions import VersionedTable, content_marks, folders, latest_hours, recent_from
from hourcast.streaming import feeds as FD

T0 = dt.datetime(2024, 3, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def hours(spark, spans, value=1.0):
    rows = [(z, at(h), value * h) for z, lo, hi in spans for h in range(lo, hi)]
    return spark.createDataFrame(rows, "zone string, ts_utc timestamp, load double").withColumn("day", F.to_date("ts_utc"))


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    assert t.version().seq == 0
    with pytest.raises(FileNotFoundError):
        t.read()
    one = t.commit(hours(spark, [("a", 0, 72), ("b", 0, 24)]), owner="x")
    opened = t.read(one)
    more = hours(spark, [("a", 24, 48)], 2.0).withColumn("extra", F.lit("new"))
    two = t.commit(more, drop=["2024-03-03"], note=1)
    assert (two.seq, two.settings) == (2, {"owner": "x", "note": 1}) and sorted(two.days) == ["2024-03-01", "2024-03-02"]
    assert {r.extra for r in t.read().where("day = '2024-03-01'").collect()} == {None}  # a column newer than the day
    assert [r.load for r in t.read(days=["2024-03-02"]).orderBy("ts_utc").limit(2).collect()] == [48.0, 50.0]
    assert opened.count() == 96  # days of the first version are still there
    # A write that is killed before its manifest leaves the version alone.
    hours(spark, [("a", 0, 24)], 9.0).write.partitionBy("day").parquet(f"{t.root}/data/run=killed")
    assert t.version() == two and t.read().count() == 72
    assert t.vacuum(keep=2) == ["killed"] and opened.count() == 96
    assert len(t.vacuum(keep=1)) == 0  # the first run still holds the first day
    t.commit(None, drop=["2024-03-01", "2024-03-02"])
    assert t.read().count() == 0 and len(t.vacuum(keep=1)) == 2


def test_written_store_freezes_and_drops(spark, tmp_path):
    store = VersionedTable(spark, f"{tmp_path}/s")
    row = "zone string, ts_utc timestamp, ts_local timestamp, metered double, m_pred double"
    fresh = lambda lo, hi, pred, met: spark.createDataFrame(
        [("a", at(h), at(h), met, pred) for h in range(lo, hi)] + [("slow", at(0), at(0), met, pred)], row)
    SV.merge_into(store, fresh(0, 30, 1.0, None), keep_days=2)
    SV.merge_into(store, fresh(20, 48, 2.0, 7.0), keep_days=2)
    got = {r.ts_utc: (r.m_pred, r.metered) for r in SV.read_store(store).where("zone = 'a'").collect()}
    assert got[at(25)] == (1.0, 7.0) and got[at(40)] == (2.0, 7.0) and got[at(5)] == (1.0, None)
    SV.merge_into(store, fresh(48, 200, 3.0, None), keep_days=2)
    kept = SV.read_store(store)
    assert kept.where("zone = 'a'").agg(F.min("ts_utc")).first()[0] == at(199 - 47)
    assert kept.where("zone = 'slow'").count() == 1  # its own latest hour counts


def test_refresh_by_content(spark, tmp_path):
    t, rows = VersionedTable(spark, f"{tmp_path}/r"), hours(spark, [("a", 0, 72), ("b", 0, 72)])
    built = []

    def build(df):
        built.append(df.count())
        return df.groupBy("zone", "day").agg(F.sum("load").alias("total"))
    assert t.refresh(rows, build) == ["2024-03-01", "2024-03-02", "2024-03-03"]
    assert t.refresh(rows.repartition(7).select("load", "day", "ts_utc", "zone"), build) == []  # order of rows and columns
    one = rows.withColumn("load", F.when(F.col("ts_utc") == F.lit(at(30)), None).otherwise(F.col("load")))
    assert t.refresh(one.where("day > '2024-03-01'"), build) == ["2024-03-02"]
    assert built == [144, 48] and t.read().count() == 4  # a day that is gone is dropped
    assert t.refresh(rows.limit(0), build) == [] and t.read().count() == 0


def test_marks_tell_nulls_and_repeats(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, 1), ("c", 1, 1), ("d", 1, 1), ("d", 1, 1)], "day string, x int, y int")
    assert content_marks(df, ["day"]).select("mark").distinct().count() == 4


def test_recent_reads_only_its_days(spark, tmp_path):
    rows = hours(spark, [("a", 0, 24 * 40), ("ended", 0, 24 * 5)])
    rows.write.partitionBy("day").parquet(f"{tmp_path}/d")
    summary = latest_hours(rows.where("day > '2024-03-20'"), latest_hours(rows.where("day <= '2024-03-20'")))
    got = recent_from(spark.read.parquet(f"{tmp_path}/d"), summary, 3)
    assert {r.zone: r.n for r in got.groupBy("zone").agg(F.count("*").alias("n")).collect()} == {"a": 72, "ended": 72}
    # The scan names the days: 3 or 4 of each zone, out of 40.
    named = got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "day" in named and "2024-03-20" not in named and "Exchange hashpartitioning" not in got._jdf.queryExecution().sparkPlan().toString()
    assert recent_from(spark.read.parquet(f"{tmp_path}/d"), summary.limit(0), 3).count() == 0


@pytest.mark.parametrize("every", [1, 2, 5])
def test_compacted_log_equals_whole_log(spark, tmp_path, every):
    log = FD.CompactedLog(spark, f"{tmp_path}/log", f"{tmp_path}/base", FD.latest_actuals)
    whole, write, keep = f"{tmp_path}/whole", FD.log_writer(f"{tmp_path}/log"), FD.log_writer(f"{tmp_path}/whole")
    with pytest.raises(FileNotFoundError):
        log.state()
    schema = "zone string, ts_utc timestamp, metered double, verified boolean, arrived_at timestamp"
    for b in range(5):
        rows = spark.createDataFrame([("a", at(24 * (k % 4)), float(10 * b + k) if (k + b) % 3 else None, (k * b) % 4 == 3, at(b)) for k in range(8)], schema)
        for w in (write, keep, write):  # a batch that is written again
            w(rows.dropDuplicates(["zone", "ts_utc"]).orderBy("ts_utc"), b)
        if b % every == every - 1:
            assert log.compact() == b and folders(spark, log.log, "batch") == []
    want = FD.current_actuals(spark.read.parquet(whole)).orderBy("zone", "ts_utc").collect()
    assert log.state().select("zone", "ts_utc", "metered", "verified").orderBy("zone", "ts_utc").collect() == want
    assert log.compact() == 4 and log.state().count() == len(want)
