"""Connected components of a graph given as pairs of whole numbers."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` (its smallest node) of every node that has an edge other than to itself.

    Rounds of large-star and small-star: neighbours hang themselves to the smallest node in sight until only
    stars are left. Minima are aggregated before their shuffle, a hub's edges are spread by the skew join, and
    each round is written, so neither lineage nor a component's size matters.
    """
    e = staged(edges.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
               .distinct(), label)
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select("v", "v").distinct())
        before = state
        sym = e.union(e.select("v", "u"))
        large = (sym.join(_least(sym), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        small = large.join(_least(large), "u")
        e = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                   .union(small.select("u", "m")).distinct(), label)
