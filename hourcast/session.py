"""Session settings the library relies on, and the shared scratch folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Hourly tables are a few per cent of their size on disk: by its file size a table of millions of rows is broadcast.
    "spark.sql.sources.fileCompressionFactor": "32",
}


def build_session(app: str = "hourcast", **extra: str) -> SparkSession:
    """A session with UTC clocks, AQE and dynamic partition overwrite."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/hourcast-{label}-{uuid.uuid4().hex[:12]}"


def require_utc(spark: SparkSession) -> None:
    """The clock functions read timestamps in the session's zone and are right in UTC only."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone is {zone}; set it to UTC")
