"""Exact quantiles and ranks of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here values are first
counted (combined before the shuffle), laid into ordered cells by a fixed monotone function of
the value, and only the cells that hold a wanted rank are sorted, each in its own task. The cell
function depends on nothing but the value, so a recomputed task always agrees with its sibling.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELLS_PER_E_FOLD = 256


def cell_of(x: Column) -> Column:
    """Ordered cell number: never decreasing in x, about 0.4 % wide in relative terms at every magnitude, so errors
    close to zero spread over as many cells as large ones. 745 is beyond the logarithm of the smallest double."""
    size = F.floor((F.ln(F.abs(x)) + 745) * CELLS_PER_E_FOLD)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("bigint") * size)


def quantiles(df: DataFrame, by: Sequence[str], col: str | Column, probs: Sequence[float],
              out: str = "q") -> DataFrame:
    """One row per group: ``out`` = array of linearly interpolated quantiles of the non-null values."""
    by = list(by)
    x = F.col(col) if isinstance(col, str) else col
    counts = (df.select(*by, x.cast("double").alias("_x")).where(F.col("_x").isNotNull())
              .groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_cell", cell_of(F.col("_x"))))
    before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = (counts.groupBy(*by, "_cell").agg(F.sum("_n").alias("_cn"))
             .withColumn("_start", F.coalesce(F.sum("_cn").over(before), F.lit(0)))
             .withColumn("_total", F.sum("_cn").over(W.partitionBy(*by))))

    # Ranks are written as SQL text: a dozen probabilities would be hundreds of Column calls.
    lo = [f"floor({float(p)!r}D * (_total - 1))" for p in probs]
    hi = [f"ceil({float(p)!r}D * (_total - 1))" for p in probs]
    needed = " OR ".join(f"({k} >= _start AND {k} < _start + _cn)" for k in lo + hi)
    inner = W.partitionBy(*by, "_cell").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    ranked = (counts.join(cells.where(needed).drop("_cn"), by + ["_cell"])
              .withColumn("_from", F.col("_start") + F.sum("_n").over(inner) - F.col("_n")))

    def at(rank: str, name: str) -> Column:
        return F.expr(f"max(CASE WHEN {rank} >= _from AND {rank} < _from + _n THEN _x END) AS {name}")

    picked = ranked.groupBy(*by).agg(
        F.max("_total").alias("_total"), *[at(k, f"_lo{i}") for i, k in enumerate(lo)],
        *[at(k, f"_hi{i}") for i, k in enumerate(hi)])
    values = [f"_lo{i} + (_hi{i} - _lo{i}) * ({float(p)!r}D * (_total - 1) - {k})"
              for i, (p, k) in enumerate(zip(probs, lo))]
    return picked.select(*by, F.expr(f"array({', '.join(values)})").alias(out))


def value_ranks(df: DataFrame, by: Sequence[str], col: str, sums: dict[str, Column] | None = None,
                rows: Column | None = None) -> DataFrame:
    """One row per (group, distinct value): ``n`` rows, ``first_rank`` (0-based), ``total`` rows of
    the group, ``lowest_n`` rows of its lowest value, and aggregates ``sums`` over the rows of the
    value.

    ``rows`` is the aggregate that counts rows, where ``df`` is counted already. Enough to place every
    value among the group's quantiles without computing one (``bin_of_rank``, ``at_or_above``), so rows
    are reduced once and never joined back to a quantile table.
    """
    by = list(by)
    n = F.count(F.lit(1)) if rows is None else rows
    aggs = [n.alias("n"), *[c.alias(k) for k, c in (sums or {}).items()]]
    values = (df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("value"))
              .agg(*aggs).withColumn("_cell", cell_of(F.col("value"))))
    before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    cells = (values.groupBy(*by, "_cell").agg(F.sum("n").alias("_cn"), F.min_by("n", "value").alias("_fn"))
             .withColumns({"_start": F.coalesce(F.sum("_cn").over(before), F.lit(0)),
                           "total": F.sum("_cn").over(whole),
                           "lowest_n": F.min_by("_fn", "_cell").over(whole)}).drop("_cn", "_fn"))
    inner = W.partitionBy(*by, "_cell").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return (values.join(cells, by + ["_cell"])
            .withColumn("first_rank", F.col("_start") + F.sum("n").over(inner) - F.col("n"))
            .drop("_cell", "_start"))


def bin_of_rank(bins: int) -> Column:
    """Right-closed equal-frequency bin of a ``value_ranks`` row.

    A value exceeds the interpolated quantile p exactly when its first rank exceeds
    floor(p * (total - 1)). An edge equal to the lowest value is the bottom of bin 0 and does not
    count; other equal edges only leave a number unused.
    """
    edges = [f"{i / bins!r}D * (total - 1)" for i in range(1, bins)]
    above = [f"CAST(first_rank > floor({h}) AND ceil({h}) >= lowest_n AS INT)" for h in edges]
    return F.expr(" + ".join(above))


def at_or_above(p: float) -> Column:
    """True when a ``value_ranks`` row is at or above the interpolated quantile p."""
    return F.expr(f"first_rank + n - 1 >= ceil({float(p)!r}D * (total - 1))")


def group_ranks(df: DataFrame, by: Sequence[str], col: str, tie: str,
                out: str = "rank", size: str = "group_size", block_hours: int = 2160) -> DataFrame:
    """1-based ascending rank of each row in its group by (col, tie), and the group's size.

    ``tie`` is a time column. Rows of one value are ranked per block of time, so even a value that
    a large share of the rows has is many small sorts.
    """
    by = list(by)
    block = F.floor(F.unix_seconds(F.col(tie).cast("timestamp")) / (3600 * block_hours))
    tagged = (df.where(F.col(col).isNotNull())
              .withColumns({"value": F.col(col).cast("double"), "_block": block}))
    earlier = W.partitionBy(*by, "value").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = tagged.groupBy(*by, "value", "_block").agg(F.count(F.lit(1)).alias("_k"))
    skips = counts.withColumn("_skip", F.coalesce(F.sum("_k").over(earlier), F.lit(0))).drop("_k")
    ranks = value_ranks(counts, by, "value", rows=F.sum("_k")).select(
        *by, "value", "first_rank", F.col("total").alias(size))
    place = skips.join(ranks, [*by, "value"])
    inner = W.partitionBy(*by, "value", "_block").orderBy(tie)
    rank = F.col("first_rank") + F.col("_skip") + F.row_number().over(inner)
    return (tagged.join(place, [*by, "value", "_block"]).withColumn(out, rank)
            .drop("value", "_block", "first_rank", "_skip"))
