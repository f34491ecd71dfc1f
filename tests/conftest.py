import datetime as dt

import pytest

from hourcast.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def make_hourly(spark):
    """(zone, start UTC, values) -> contiguous hourly frame with local clock of New York."""
    from pyspark.sql import functions as F
    from hourcast.functions import local_of

    def make(start: dt.datetime, columns: dict, zone: str = "a"):
        n = len(next(iter(columns.values())))
        rows = [(zone, start + dt.timedelta(hours=i), *[c[i] for c in columns.values()]) for i in range(n)]
        schema = "zone string, ts_utc timestamp, " + ", ".join(f"{c} double" for c in columns)
        return spark.createDataFrame(rows, schema).withColumn("ts_local", local_of(F.col("ts_utc"), "America/New_York"))
    return make
