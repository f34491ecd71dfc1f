"""Streaming forms of ingestion and of the store.

A sink is an append-only log with one ``batch`` partition per micro-batch. A retried batch
replaces its own partition, so the log holds each batch once; readers resolve it by the store's
rules. Nothing is read and overwritten in place.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import DAY, VersionedTable, folders, remove_folder


def hourly_load(feed: DataFrame, value: str | Column, zone: str = "zone", ts: str = "ts",
                lateness: str = "3 hours") -> DataFrame:
    """Meter events -> (zone, ts_utc, total, n) per finished hour; later rows are dropped."""
    v = F.col(value) if isinstance(value, str) else value
    hours = (feed.withWatermark(ts, lateness).groupBy(F.window(ts, "1 hour"), zone)
             .agg(F.sum(v).alias("total"), F.count(F.lit(1)).alias("n")))
    return hours.select(F.col(zone).alias("zone"), F.col("window.start").alias("ts_utc"), "total", "n")


def first_written(preds: DataFrame, ts: str = "issued_at", lateness: str = "21 days") -> DataFrame:
    """Streaming freeze: the first prediction per (zone, ts_utc, model) within the watermark.

    A key must stay in state for as long as it is issued anew: the daily roll's window (8), horizon (2) and
    kept days (10), and one more."""
    return preds.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["zone", "ts_utc", "model"])


def log_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that appends a batch to the log, once however often it is retried."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))
    return write


def start_log(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
              available_now: bool = True) -> StreamingQuery:
    """Run a stream into a log; with ``available_now`` it stops after the data at hand."""
    writer = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
              .foreachBatch(log_writer(path)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_actuals(rows: DataFrame) -> DataFrame:
    """One row of the log per (zone, ts_utc): verified beats unverified, then the newest arrival. What it keeps
    can be resolved again together with later batches."""
    order = F.struct(F.col("verified").cast("int"), F.col("batch"), F.col("arrived_at"))
    rest = ["metered", "verified", "batch", "arrived_at"]
    best = (rows.where(F.col("metered").isNotNull()).groupBy("zone", "ts_utc")
            .agg(F.max_by(F.struct(*rest), order).alias("_b")))
    return best.select("zone", "ts_utc", *[F.col(f"_b.{c}").alias(c) for c in rest])


def first_predictions(rows: DataFrame) -> DataFrame:
    """One row of the log per (zone, ts_utc, model): the one written first; can be resolved again."""
    rest = ["pred", "batch", "issued_at"]
    best = (rows.where(F.col("pred").isNotNull()).groupBy("zone", "ts_utc", "model")
            .agg(F.min_by(F.struct(*rest), F.struct("batch", "issued_at")).alias("_b")))
    return best.select("zone", "ts_utc", "model", *[F.col(f"_b.{c}").alias(c) for c in rest])


def current_actuals(log: DataFrame) -> DataFrame:
    """(zone, ts_utc, metered, verified) of a log."""
    return latest_actuals(log).select("zone", "ts_utc", "metered", "verified")


def frozen_predictions(log: DataFrame) -> DataFrame:
    """(zone, ts_utc, model, pred): the value written first wins over every later run."""
    return first_predictions(log).select("zone", "ts_utc", "model", "pred")


class CompactedLog:
    """A log of batches behind a resolved base.

    ``compact`` resolves base and newer batches into the days they touch and commits them together with the
    number of the last batch, so base and number always fit; batches up to it are then removed. ``state`` reads
    the base and the batches after it, whether or not the others are gone yet.
    """

    def __init__(self, spark: SparkSession, log: str, base: str, resolve: Callable[[DataFrame], DataFrame]):
        self.spark, self.log, self.resolve, self.base = spark, log, resolve, VersionedTable(spark, base)

    def _later(self, upto: int) -> DataFrame | None:
        later = [b for b in map(int, folders(self.spark, self.log, "batch")) if b > upto]
        if not later:
            return None
        return self.spark.read.option("basePath", self.log).parquet(*[f"{self.log}/batch={b}" for b in later])

    def state(self) -> DataFrame:
        """The resolved rows of all batches, with the columns that decide between rows."""
        version = self.base.version()
        later = self._later(version.settings.get("upto", -1))
        if version.schema is None:
            if later is None:
                raise FileNotFoundError(f"neither a batch under {self.log} nor a base")
            return self.resolve(later)
        base = self.base.read(version).drop(DAY)
        return base if later is None else self.resolve(base.unionByName(later.select(*base.columns)))

    def compact(self) -> int:
        """Move all batches into the base; returns the number of the last one. Days without new rows stay as
        they are."""
        version = self.base.version()
        upto = version.settings.get("upto", -1)
        later = self._later(upto)
        if later is not None:
            last = max(int(b) for b in folders(self.spark, self.log, "batch"))
            rows = later.where(F.col("batch") <= last).withColumn(DAY, F.to_date("ts_utc"))
            touched = [r[DAY].isoformat() for r in rows.select(DAY).distinct().collect()]
            new = rows.drop(DAY)
            if version.schema is not None:
                old = self.base.read(version, touched).drop(DAY)
                new = old.unionByName(new.select(*old.columns))
            self.base.commit(self.resolve(new).withColumn(DAY, F.to_date("ts_utc")), upto=last)
            upto = last
        for b in map(int, folders(self.spark, self.log, "batch")):
            if b <= upto:
                remove_folder(self.spark, f"{self.log}/batch={b}")
        return upto


def compact(spark: SparkSession, resolved: DataFrame, target: str) -> DataFrame:
    """Write the resolved state as a new table of its own; for a log that goes on see ``CompactedLog``."""
    resolved.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)
