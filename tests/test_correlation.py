import numpy as np
import pytest

from hourcast.operators.correlation import correlations


def test_a_thousand_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 1000)) @ np.diag(rng.uniform(1, 1e3, 1000)) + 1e6
    names = [f"c{k}" for k in range(1000)]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    out = correlations(df, names, "v", block=300).toPandas()
    assert len(out) == 1000 * 1001 // 2 and set(out["n"]) == {120}
    got = np.zeros((1000, 1000))
    got[out["a"].str[1:].astype(int), out["b"].str[1:].astype(int)] = out["r"]
    np.testing.assert_allclose(got, np.triu(np.corrcoef(x.T)), atol=1e-9)


def test_missing_and_constant(spark):
    import pandas as pd
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(60, 5)), columns=list("pqrst"))
    pdf.loc[::3, "q"], pdf["s"], pdf.loc[1:, "t"] = np.nan, 7.1, np.nan
    out = correlations(spark.createDataFrame(pdf).repartition(4), list("pqrst"), block=2).collect()
    want = pdf.corr()
    for row in out:
        if {row.a, row.b} & {"s", "t"}:
            assert row.r is None
        else:
            assert row.n == pdf[[row.a, row.b]].dropna().shape[0] and abs(row.r - want.loc[row.a, row.b]) < 1e-9
    assert {(r.a, r.b) for r in out} == {(a, b) for k, a in enumerate('pqrst') for b in 'pqrst'[k:]} - {('q', 't')} and correlations(spark.createDataFrame(pdf).limit(0), list("pqrst")).count() == 0


def test_wrong_width(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    with pytest.raises(ValueError):
        correlations(df, ["a"], "v")
