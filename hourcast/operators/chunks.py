"""Windows over a long series without one task per zone.

A zone may hold a large share of all rows, so nothing here sorts a whole zone in one task. Rows
are cut into chunks of ``size`` positions; a window runs per (zone, chunk) and what has to cross
a chunk border does so in one of two ways:

* bounded causal frames: the last ``before`` rows are copied into the next chunk (``with_halo``);
* unbounded frames: one summary row per (zone, chunk) is windowed over the zone and joined back
  on (zone, chunk), so the hourly rows are shuffled once and never by zone alone.

A summary holds at most one row per chunk of the calendar, so its zone windows stay small.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_HOURS = 2160


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_seconds(ts) / 3600)


def clock_position(df: DataFrame, ts: str = "ts_utc", out: str = "pos") -> DataFrame:
    """Position as arithmetic; equals the row position once the series has no holes."""
    return df.withColumn(out, hour_number(F.col(ts)))


def rank_position(df: DataFrame, by: Sequence[str] = ("zone",), ts: str = "ts_utc",
                  out: str = "pos", size: int = CHUNK_HOURS) -> DataFrame:
    """Dense 0-based row position of each row within its zone, holes or not."""
    by = list(by)
    tagged = df.withColumn("_cell", F.floor(hour_number(F.col(ts)) / size))
    cells = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = (tagged.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(cells), F.lit(0))).drop("_n"))
    rows = W.partitionBy(*by, "_cell").orderBy(ts)
    return (tagged.join(starts, by + ["_cell"])
            .withColumn(out, F.col("_start") + F.row_number().over(rows) - 1)
            .drop("_cell", "_start"))


def with_position(df: DataFrame, how: str = "rank", ts: str = "ts_utc") -> DataFrame:
    """``pos`` by "clock" (contiguous series) or "rank" (any series); kept if already there."""
    if "pos" in df.columns:
        return df
    if how == "clock":
        return clock_position(df, ts)
    if how == "rank":
        return rank_position(df, ts=ts)
    raise ValueError(f"unknown position mode {how!r}")


def with_halo(df: DataFrame, before: int, size: int = CHUNK_HOURS, pos: str = "pos") -> DataFrame:
    """Tag rows with ``chunk`` and copy each row into every chunk that looks back at it.

    ``is_home`` marks the one copy that belongs to the chunk; keep only those after a window.
    """
    home = F.floor(F.col(pos) / size)
    reach = F.floor((F.col(pos) + before) / size)
    return (df.withColumn("chunk", F.explode(F.sequence(home, reach)))
            .withColumn("is_home", F.col("chunk") == home))


def chunk_window(by: Sequence[str] = ("zone",), pos: str = "pos"):
    """Ordered window inside one chunk."""
    return W.partitionBy(*by, "chunk").orderBy(pos)


def causal(df: DataFrame, columns: dict[str, Column], before: int, by: Sequence[str] = ("zone",),
           size: int = CHUNK_HOURS) -> DataFrame:
    """Add window ``columns`` whose frames (over ``chunk_window``) reach back <= ``before`` rows."""
    out = with_halo(df, before, size).withColumns(columns)
    return out.where("is_home").drop("chunk", "is_home")


def neighbours(df: DataFrame, cols: Sequence[str], how: str = "rank", by: Sequence[str] = ("zone",),
               ts: str = "ts_utc", size: int = CHUNK_HOURS,
               totals: dict[str, tuple[Column, Callable]] | None = None) -> DataFrame:
    """For each column add ``_prev_c`` / ``_next_c``: struct(pos, v) of the closest non-null value at
    or before / at or after the row, however far away; and the row's own ``_pos``.

    ``how`` is the position mode. ``totals`` attaches zone-level values as ``zone_totals`` does, from
    the same summary. Rows are shuffled once, by (zone, block of time).
    """
    by, totals = list(by), totals or {}
    cell = [*by, "_cell"]
    tagged = df.withColumn("_cell", F.floor(hour_number(F.col(ts)) / size))
    if how == "rank":
        tagged = tagged.withColumn("_local", F.row_number().over(W.partitionBy(*cell).orderBy(ts)) - 1)
    elif how == "clock":
        tagged = tagged.withColumn("_local", hour_number(F.col(ts)) - F.col("_cell") * size)
    else:
        raise ValueError(f"unknown position mode {how!r}")

    def known(c: str, pos: Column) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(pos.alias("pos"), F.col(c).alias("v")))

    def moved(c: str) -> Column:
        """The same value with its position counted from the zone's start."""
        return F.when(F.col(c).isNotNull(), F.struct(
            (F.col("_start") + F.col(c)["pos"]).alias("pos"), F.col(c)["v"].alias("v")))

    earlier = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, -1)
    start = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) if how == "rank" else F.col("_cell") * size)
    ends = tagged.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(known(c, F.col("_local"))).alias(f"_last_{c}") for c in cols],
        *[F.min(known(c, F.col("_local"))).alias(f"_first_{c}") for c in cols],
        *[agg.alias(n) for n, (agg, _) in totals.items()])
    carry = ends.withColumn("_start", start).select(
        *cell, "_start",
        *[F.last(moved(f"_last_{c}"), True).over(earlier).alias(f"_before_{c}") for c in cols],
        *[F.last(moved(f"_first_{c}"), True).over(later).alias(f"_after_{c}") for c in cols],
        *[f(n).over(W.partitionBy(*by)).alias(n) for n, (_, f) in totals.items()])
    up = W.partitionBy(*cell).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*cell).orderBy(F.desc("_pos")).rowsBetween(W.unboundedPreceding, 0)
    out = tagged.join(carry, cell).withColumn("_pos", F.col("_start") + F.col("_local"))
    for name, w, beyond in (("_prev_", up, "_before_"), ("_next_", down, "_after_")):
        out = out.withColumns({f"{name}{c}": F.coalesce(F.last(known(c, F.col("_pos")), True).over(w),
                                                        F.col(f"{beyond}{c}")) for c in cols})
    return out.drop("_cell", "_local", "_start", *[f"_before_{c}" for c in cols], *[f"_after_{c}" for c in cols])


def zone_totals(df: DataFrame, totals: dict[str, tuple[Column, Callable]], by: Sequence[str] = ("zone",),
                ts: str = "ts_utc", size: int = CHUNK_HOURS) -> DataFrame:
    """Attach zone-level values to every row: ``name: (aggregate, combine)``, e.g.
    ``(F.max(x), F.max)``.

    Reduced per (zone, block of time), combined over the zone's few blocks and joined back on
    (zone, block): rows are never gathered by zone, and what follows is not partitioned by zone
    alone either, so a zone with a large share of the rows keeps its parallelism.
    """
    by = list(by)
    tagged = df.withColumn("_block", F.floor(hour_number(F.col(ts)) / size))
    blocks = tagged.groupBy(*by, "_block").agg(*[agg.alias(n) for n, (agg, _) in totals.items()])
    zone = W.partitionBy(*by)
    whole = blocks.select(*by, "_block", *[f(n).over(zone).alias(n) for n, (_, f) in totals.items()])
    return tagged.join(whole, by + ["_block"]).drop("_block")


def salted_join(df: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", salts: int = 16) -> DataFrame:
    """Join a per-group table to rows whose groups may be very uneven.

    Each group is cut into ``salts`` parts by a hash of ``spread_by`` and the small side repeated
    for each, so no group is one task, whatever join Spark picks from the sizes.
    """
    parts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    return df.withColumn("_salt", salt).join(parts, [*on, "_salt"], how).drop("_salt")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by ``order``. Combined before the shuffle, so a key repeated
    any number of times never gathers its copies in one task."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
