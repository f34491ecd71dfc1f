"""Tables in day partitions whose versions are switched by one small file.

``root/data/run=<id>/day=<d>`` holds what one commit wrote, ``root/manifest/seq=<n>`` says which run each day is
read from, with the schema and a few settings. A commit writes its days first and its manifest last, as
one file that appears whole or not at all: a killed write is invisible, days that did not change are not
written again, and a reader keeps the version it opened until ``vacuum`` removes it. One writer at a time.

What goes through the driver is one line a day, so it is bounded by the calendar, not by zones or rows.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructType

DAY = "day"


@dataclass(frozen=True)
class Version:
    """What a manifest holds: per day the run that wrote it and the mark of its contents, if it has one."""

    seq: int = 0
    schema: dict | None = None
    days: dict[str, list] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)


def content_marks(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, mark``: row count and sum of row hashes per group, the same in any order of rows or files. Sums are
    combined before the shuffle, so a group of any size is a few rows."""
    columns = sorted(c for c in df.columns if c not in by)
    # A null is named, so it does not hash like the value to its left.
    rows = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    total = F.sum(rows.cast("decimal(38,0)"))
    return df.groupBy(*by).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total.cast("string")).alias("mark"))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    where, fs = _files(spark, path)
    fs.delete(where, True)


def folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the ``key=<value>`` folders under a path."""
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(n[len(key) + 1:] for n in names if n.startswith(f"{key}="))


class VersionedTable:
    """Rows with a date column ``day``, which names their partition."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> Version:
        """The newest manifest; version 0 without rows if there is none."""
        try:
            lines = self.spark.read.text(f"{self.root}/manifest").orderBy(F.desc("seq")).limit(1).collect()
        except AnalysisException:
            lines = []
        return Version(**json.loads(lines[0].value)) if lines else Version()

    def read(self, version: Version | None = None, days: Iterable[str] | None = None) -> DataFrame:
        """The rows of a version; with ``days`` (as text) only their folders are listed."""
        version = version or self.version()
        if version.schema is None:
            raise FileNotFoundError(f"no version under {self.root}")
        schema = StructType.fromJson(version.schema)
        wanted = set(version.days) if days is None else set(days)
        paths = [f"{self.root}/data/run={run}/{DAY}={d}" for d, (run, _) in sorted(version.days.items()) if d in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths)
        return rows.select(*schema.names)

    def commit(self, rows: DataFrame | None, drop: Iterable[str] = (), marks: dict[str, str] | None = None,
               **settings) -> Version:
        """A new version: each day of ``rows`` is replaced by them, the days of ``drop`` go, settings are added.
        A column that is new gives null on the days written before."""
        old = self.version()
        days, schema = {d: v for d, v in old.days.items() if d not in set(drop)}, old.schema
        if rows is not None:
            if not isinstance(rows.schema[DAY].dataType, DateType):
                raise ValueError(f"{DAY} must be a date")
            run = uuid.uuid4().hex[:12]
            rows.write.partitionBy(DAY).parquet(f"{self.root}/data/run={run}")
            days |= {d: [run, (marks or {}).get(d)] for d in folders(self.spark, f"{self.root}/data/run={run}", DAY)}
            known = StructType.fromJson(schema) if schema else StructType()
            more = [f for f in rows.schema.fields if f.name not in known.names]
            schema = StructType([*known.fields, *more]).jsonValue()
        new = Version(old.seq + 1, schema, days, {**old.settings, **settings})
        line = self.spark.createDataFrame([(json.dumps(new.__dict__),)], "value string")
        line.coalesce(1).write.mode("errorifexists").text(f"{self.root}/manifest/seq={new.seq}")
        return new

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove runs and manifests that none of the newest ``keep`` versions needs, and what killed writes
        left. Returns the runs that went."""
        seqs = sorted(map(int, folders(self.spark, f"{self.root}/manifest", "seq")))
        lines = self.spark.read.text(f"{self.root}/manifest").where(F.col("seq").isin(seqs[-keep:])).collect()
        needed = {run for line in lines for run, _ in json.loads(line.value)["days"].values()}
        gone = [r for r in folders(self.spark, f"{self.root}/data", "run") if r not in needed]
        for seq in seqs[:-keep]:
            remove_folder(self.spark, f"{self.root}/manifest/seq={seq}")
        for run in gone:
            remove_folder(self.spark, f"{self.root}/data/run={run}")
        return gone

    def refresh(self, rows: DataFrame, build: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[str]:
        """Bring the table to ``build(rows)``, day by day: only days whose input changed since the last refresh are
        built and written, days that are gone are dropped. ``build`` must make a day from that day's rows.
        Returns the days written."""
        old = self.version()
        marks = {r[DAY].isoformat(): r.mark for r in content_marks(rows, [DAY]).collect()}
        changed = sorted(d for d, m in marks.items() if old.days.get(d, [None, None])[1] != m)
        gone = [d for d in old.days if d not in marks]
        if changed:
            some = rows.where(F.col(DAY).isin([F.lit(d).cast("date") for d in changed]))
            self.commit(build(some), [*changed, *gone], marks)
        elif gone:
            self.commit(None, gone)
        return changed


def latest_hours(rows: DataFrame, known: DataFrame | None = None, ts: str = "ts_utc") -> DataFrame:
    """``zone, last_ts``: the maintained summary of a table, from its newly written rows and the summary so far."""
    new = rows.groupBy("zone").agg(F.max(ts).alias("last_ts"))
    if known is None:
        return new
    return known.unionByName(new).groupBy("zone").agg(F.max("last_ts").alias("last_ts"))


def recent_from(rows: DataFrame, summary: DataFrame, days: int, ts: str = "ts_utc", partition: str = DAY,
                of: Callable[[Column], Column] = F.to_date) -> DataFrame:
    """Rows after each zone's latest hour minus ``days``, without reading the history: the partitions that hold such
    an hour are looked up in the summary (``of`` gives the partition of a time) and named in the filter, so
    the scan lists no other. A zone that ended long ago adds its own last days only."""
    start = F.col("last_ts") - F.make_dt_interval(days=F.lit(days))
    step = F.make_dt_interval(days=F.lit(1))
    spans = summary.where("last_ts is not null").select(F.explode(F.array_distinct(F.transform(
        F.concat(F.sequence(start, F.col("last_ts"), step), F.array("last_ts")), lambda t: of(t)))).alias("p")).distinct()
    wanted = [r.p for r in spans.collect()]  # bounded by the calendar
    some = rows.where(F.col(partition).isin(wanted)) if wanted else rows.limit(0)
    return some.join(summary, "zone").where(F.col(ts) > start).drop("last_ts")
