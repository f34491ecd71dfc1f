"""Driver queries: name -> (Spark callable, DuckDB SQL or None)."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What the queries rely on, whoever built the session.
SESSION = {"spark.sql.session.timeZone": "UTC", "spark.sql.sources.partitionOverwriteMode": "dynamic",
           "spark.sql.sources.fileCompressionFactor": "32"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


NUDGE = 1e-9


def rnd(c: str | Column, digits: int) -> Column:
    """Round, with exact ties pushed off the edge: sums of cents often end in a 5 that two engines'
    summation orders would otherwise round differently."""
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, digits)


def steady(sql: str) -> str:
    """The same nudge for every two-argument ROUND of the oracle."""
    out, i = [], 0
    while (start := sql.find("ROUND(", i)) >= 0:
        depth, comma, j = 1, None, start + 6
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[j], 0)
            if sql[j] == "," and depth == 1:
                comma = j
            j += 1
        if comma is None:
            out.append(sql[i:start + 6])
            i = start + 6
            continue
        inner = steady(sql[start + 6:comma])
        out.append(f"{sql[i:start]}ROUND({inner} + {NUDGE}{sql[comma:j]}")
        i = j
    return "".join(out) + sql[i:]


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its oracle."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in SESSION.items():
                spark.conf.set(key, value)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = steady(sql)
        return fn
    return add
