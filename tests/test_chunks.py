import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hourcast.operators.chunks import (causal, chunk_window, keep_first, neighbours, rank_position, salted_join,
                                       zone_totals)
from hourcast.operators.quality import fill_forward_back, gaps, gate_contiguous, interpolate, repair_impossible
from hourcast.operators.quantiles import at_or_above, bin_of_rank, group_ranks, quantiles, value_ranks

T0 = dt.datetime(2024, 1, 1)


def sparse(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = []
    for z in ("a", "b"):
        hours = sorted(rnd.sample(range(n * 3), n))
        rows += [(z, T0 + dt.timedelta(hours=h), float(rnd.randint(-50, 50)) if rnd.random() > 0.4 else None) for h in hours]
    return spark.createDataFrame(rows, "zone string, ts_utc timestamp, x double"), pd.DataFrame(rows, columns=["zone", "ts_utc", "x"])


def test_rank_position_and_causal_across_chunks(spark):
    df, pdf = sparse(spark)
    ranked = rank_position(df, size=50)
    w = chunk_window().rowsBetween(-19, 0)
    got = causal(ranked, {"s": F.sum("x").over(w), "l": F.lag("x", 20).over(chunk_window())}, 20, size=25).toPandas()
    got = got.sort_values(["zone", "ts_utc"]).reset_index(drop=True)
    pdf = pdf.sort_values(["zone", "ts_utc"]).reset_index(drop=True)
    g = pdf.groupby("zone")["x"]
    assert (got["pos"].to_numpy() == pdf.groupby("zone").cumcount().to_numpy()).all()
    want = g.transform(lambda s: s.rolling(20, min_periods=1).sum())
    pd.testing.assert_series_equal(got["s"], want, check_names=False)
    pd.testing.assert_series_equal(got["l"], g.shift(20), check_names=False)


def test_neighbours_far_away(spark):
    df, pdf = sparse(spark, seed=2)
    got = neighbours(df, ["x"], size=7)
    got = got.select("zone", "ts_utc", F.col("_prev_x.v").alias("p"), F.col("_next_x.v").alias("n")).toPandas()
    got = got.sort_values(["zone", "ts_utc"]).reset_index(drop=True)
    g = pdf.sort_values(["zone", "ts_utc"]).reset_index(drop=True).groupby("zone")["x"]
    pd.testing.assert_series_equal(got["p"], g.ffill(), check_names=False)
    pd.testing.assert_series_equal(got["n"], g.bfill(), check_names=False)


def test_interpolate_matches_positional_line(spark):
    df, pdf = sparse(spark, seed=3)
    got = interpolate(df, "x").toPandas().sort_values(["zone", "ts_utc"])["x"].to_numpy()
    s = pdf.sort_values(["zone", "ts_utc"]).groupby("zone")["x"]
    want = s.transform(lambda v: v.interpolate("linear").ffill().bfill()).to_numpy()
    np.testing.assert_allclose(got, want)
    inside = interpolate(df, "x", inside_only=True).toPandas().sort_values(["zone", "ts_utc"])["x"].to_numpy()
    np.testing.assert_allclose(inside, s.transform(lambda v: v.interpolate("linear", limit_area="inside")).to_numpy())
    short = interpolate(df, "x", inside_only=True, max_gap=1)
    assert short.where("x IS NULL").count() > int(np.isnan(inside).sum())
    filled = fill_forward_back(df, ["x"]).toPandas().sort_values(["zone", "ts_utc"])["x"].to_numpy()
    np.testing.assert_allclose(filled, s.transform(lambda v: v.ffill().bfill()).to_numpy())


def test_bad_load_only_when_triggered(make_hourly):
    bad = make_hourly(T0, {"load": [5.0, None, -1.0, 8.0, 0.0, None]}, "a")
    clean = make_hourly(T0, {"load": [5.0, None, 7.0, 8.0, 9.0, None]}, "b")
    out = repair_impossible(bad.unionByName(clean)).orderBy("zone", "ts_utc").toPandas()
    a, b = (out[out.zone == z]["load"].tolist() for z in "ab")
    assert a[:4] == [5.0, 6.0, 7.0, 8.0] and np.isnan(a[4:]).all()
    assert np.isnan(b[1]) and b[2:5] == [7.0, 8.0, 9.0]


def test_gate(make_hourly):
    good = make_hourly(T0, {"x": [0.0] * 50})
    assert gaps(good).count() == 0 and gate_contiguous(good) is good
    holed = good.where(F.hour("ts_utc") != 5)
    try:
        gate_contiguous(holed)
        raise AssertionError("gate let a hole pass")
    except ValueError as e:
        assert "2024-01-01 06:00" in str(e)


def test_keep_first_and_joins(spark):
    rows = [("a", i % 3, i) for i in range(100)] + [("b", 0, 5)]
    df = spark.createDataFrame(rows, "zone string, k int, v int")
    assert sorted(map(tuple, keep_first(df, ["zone", "k"], ["v"]).collect())) == [
        ("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 0, 5)]
    small = spark.createDataFrame([("a", 10), ("b", 20)], "zone string, w int")
    assert salted_join(df, small, ["zone"], ["v"]).agg(F.sum("w")).first()[0] == 1000 + 20
    ts = df.withColumn("ts_utc", F.timestamp_seconds(F.col("v") * 3600 * 100))
    out = zone_totals(ts, {"m": (F.max("v"), F.max), "n": (F.count(F.lit(1)), F.sum)}, size=24)
    assert {tuple(r) for r in out.select("zone", "m", "n").distinct().collect()} == {("a", 99, 100), ("b", 5, 1)}


def test_quantiles_and_ranks_match_numpy(spark):
    rnd = random.Random(7)
    rows = [("a", round(rnd.gauss(0, 300), 1), i) for i in range(500)] + [("a", 0.0, 500 + i) for i in range(300)]
    rows += [("b", float(i % 4), i) for i in range(37)] + [("c", None, 0), ("d", 1e-7, 0), ("d", -1e12, 1), ("d", 1e12, 2)]
    df = spark.createDataFrame(rows, "g string, x double, i int").withColumn("t", F.timestamp_seconds(F.col("i") * 3600))
    probs = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "x", probs).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x", "i"]).dropna()
    assert set(got) == set("abd")
    for g, v in pdf.groupby("g")["x"]:
        np.testing.assert_allclose(got[g], np.quantile(v, probs), rtol=1e-12, atol=1e-9)
    ranked = value_ranks(df, ["g"], "x").withColumns({"b": bin_of_rank(10), "top": at_or_above(0.9)}).toPandas()
    for g, v in pdf.groupby("g")["x"]:
        mine = ranked[ranked.g == g]
        if g != "d":
            want = pd.qcut(v, 10, labels=False, duplicates="drop")
            pairs = {(mine.set_index("value")["b"][x], c) for x, c in zip(v, want)}
            assert len(pairs) == len({a for a, _ in pairs}) == len({c for _, c in pairs})
        assert set(mine[mine.top]["value"]) == set(v[v >= np.quantile(v, 0.9)])
    r = group_ranks(df, ["g"], "x", "t", block_hours=10).toPandas().sort_values(["g", "x", "t"])
    assert (r["rank"].to_numpy() == (r.groupby("g").cumcount() + 1).to_numpy()).all()


def test_small_values_spread_over_cells(spark):
    """100,000 values below 0.004 lie in many cells, in order, and their quantiles are exact."""
    import numpy as np
    from pyspark.sql import functions as F

    from hourcast.operators.quantiles import cell_of, quantiles
    x = np.concatenate([np.random.default_rng(1).uniform(0, 0.004, 99_990), [0.0, -0.0, 5e-324, -5e-324, -1e-9, 1e308, -1e308, 1.0, -1.0, 3.0]])
    df = spark.createDataFrame([("a", float(v)) for v in x], "zone string, v double").repartition(8)
    cells = df.select("v", cell_of(F.col("v")).alias("c")).orderBy("v").toPandas()
    assert cells["c"].is_monotonic_increasing and cells["c"].value_counts().max() < 1000
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    assert np.allclose(quantiles(df, ["zone"], "v", probs).first()["q"], np.quantile(x, probs), rtol=1e-12)
