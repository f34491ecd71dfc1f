"""Landed load files."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.chunks import keep_first
from ..operators.quality import (drop_unverified_tail, interpolate, null_upper_outliers, rescale)
from ..schema import LOAD_EST_DIVISOR, METERED, PRELIMINARY
from .tables import stage


def scan_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All CSV files of a glob with an explicit schema; no match is an error.

    ``file`` and ``file_row`` order the rows as they stand in the files.
    """
    try:
        raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    except AnalysisException as e:
        raise FileNotFoundError(f"no files matching {path!r}") from e
    # Ids grow along a file block, and a block is read by one task.
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return raw.withColumns({"file": F.col("_metadata.file_path"), "file_row": place})


def year_range(scan: DataFrame, pattern: str = r"(\d{4})\.csv$") -> DataFrame:
    """(first_year, last_year) from file names ``..._<year>.csv``, or another path pattern."""
    year = F.regexp_extract("file", pattern, 1)
    return scan.where(year != "").agg(F.min(year.cast("int")).alias("first_year"),
                                      F.max(year.cast("int")).alias("last_year"))


def _parse(c: str):
    """UTC instant from naive (taken as UTC) or offset-carrying text."""
    return F.to_timestamp(F.col(c))


def _local(c: str):
    return F.to_timestamp(F.col(c)).cast("timestamp_ntz")


def best_metered(scan: DataFrame, zone: str = "zone") -> DataFrame:
    """Metered load with the unverified tail: (zone, ts_utc, ts_local, load, is_verified)."""
    rows = scan.select(
        F.lower(zone).alias("zone"), _parse("datetime_beginning_utc").alias("ts_utc"),
        _local("datetime_beginning_ept").alias("ts_local"), F.col("mw").alias("load"),
        "is_verified", "file", "file_row")
    return keep_first(rows, ["zone", "ts_utc"], ["file", "file_row"]).drop("file", "file_row")


def load_metered(spark: SparkSession, path: str) -> DataFrame:
    """Verified metered load: union of files, first row per hour, unverified tail dropped."""
    # The verified end and the rows up to it are read one after the other; files are deduplicated once.
    rows = stage(best_metered(scan_csv(spark, path, METERED)), "metered")
    return drop_unverified_tail(rows).select("zone", "ts_utc", "ts_local", "load")


def load_preliminary(spark: SparkSession, path: str, zones: Mapping[str, str] | None = None,
                     divisors: Mapping[str, float] = LOAD_EST_DIVISOR) -> DataFrame:
    """Preliminary load: first row per hour, gross outliers bridged, rescaled to the zone.

    ``zones`` maps a load area to the zone it stands for; other areas keep their own name.
    """
    area = F.lower("load_area")
    if zones:
        pairs = [F.lit(v.lower()) for kv in sorted(zones.items()) for v in kv]
        area = F.coalesce(F.create_map(*pairs)[area], area)
    rows = scan_csv(spark, path, PRELIMINARY).select(
        area.alias("zone"), _parse("datetime_beginning_utc").alias("ts_utc"),
        F.col("prelim_load_avg_hourly").alias("load_est"), "file", "file_row")
    first = keep_first(rows, ["zone", "ts_utc"], ["file", "file_row"]).drop("file", "file_row")
    # The quantiles and the bridging read these rows several times; they are deduplicated once.
    return rescale(clean_preliminary(stage(first, "preliminary")), "load_est", divisors)


def clean_preliminary(rows: DataFrame) -> DataFrame:
    """Outliers to null, then a straight line across them and the nearest value at the ends."""
    return interpolate(null_upper_outliers(rows, "load_est"), "load_est")
