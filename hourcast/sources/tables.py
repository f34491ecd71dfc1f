"""Partitioned tables on shared storage."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.chunks import zone_totals
from ..session import scratch_dir


def years_to_refresh(update: Sequence[int], current: int, start: int, end: int,
                     skip_existing: bool = True) -> list[int]:
    """Years a run rewrites: the listed ones and the current year, or the whole range."""
    span = range(start, end + 1)
    return [y for y in span if not skip_existing or y in update or y >= current]


def refresh_years(df: DataFrame, path: str, years: Sequence[int], ts: str = "ts_utc",
                  partition: Sequence[str] | None = None) -> None:
    """Overwrite only the (zone, year) partitions of ``df`` in ``years``; other years and the zones that are
    not in ``df`` stay as they are. A table without zones is partitioned by year."""
    if partition is None:
        partition = ["zone", "year"] if "zone" in df.columns else ["year"]
    if "year" not in partition:
        raise ValueError("the year must be a partition column")
    rows = df.withColumn("year", F.year(ts)).where(F.col("year").isin(*years))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition).parquet(path))


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), fmt: str = "parquet", compression: str | None = None) -> None:
    """Replace a whole table, in Parquet or CSV."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if compression:
        writer = writer.option("compression", compression)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.format(fmt).option("header", "true").save(path)


def stage(df: DataFrame, label: str, partition: Sequence[str] = ()) -> DataFrame:
    """Cut a plan: write it once under the shared checkpoint folder and read it back.

    A lost executor then costs a re-read, not a re-computation, and filters on the partition
    columns and columns not selected are pruned by the scan.
    """
    path = scratch_dir(df.sparkSession, label)
    write_table(df, path, partition)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recent(df: DataFrame, days: int = 45, ts: str = "ts_utc") -> DataFrame:
    """Rows after each zone's latest hour minus ``days``."""
    return (zone_totals(df, {"_max": (F.max(ts), F.max)}, ts=ts)
            .where(F.col(ts) > F.col("_max") - F.make_dt_interval(days=F.lit(days))).drop("_max"))


def union_shards(*shards: DataFrame) -> DataFrame:
    """Shards of one schema as one frame, by name."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


def by_magnitude(df: DataFrame, col: str, *ties: str | Column) -> DataFrame:
    """Nearest zero first."""
    return df.orderBy(F.abs(col), *ties)
