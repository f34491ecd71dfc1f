import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "mape" in df.columns


def test_no_row_udf_no_local_checkpoint_no_cross_join():
    banned = re.compile(r"F\.udf|localCheckpoint|crossJoin|\.toPandas\(|\.rdd\b")
    hits = [(p.name, m.group()) for p in (ROOT / "hourcast").rglob("*.py") for m in banned.finditer(p.read_text())]
    assert hits == []
