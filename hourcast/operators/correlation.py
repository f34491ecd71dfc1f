"""Correlation of thousands of columns: Gram blocks by (column block, column block).

A row holds its values as one array. For each block of columns every task multiplies its rows' block with all columns
from there on (a few matrix products a batch) and gives the sums of each pair once; they are added up before
and after the shuffle. Memory of a task is ``block`` times the number of columns, whatever the number of rows; the
plan has one scan a block, of the arrays written once, instead of one aggregate expression a pair.

A pair is computed from the rows where both values are there; nulls and NaN are missing. A pair with fewer than two
such rows, or a column that does not vary in them, has a null correlation.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import stage

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
_OUT = 100_000


def _values(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if len(flat) != len(column) * width:
        raise ValueError(f"every row needs an array of {width} values")
    return flat.reshape(len(column), width)


def _pair_sums(rows: DataFrame, width: int, lo: int, hi: int, shift: np.ndarray) -> DataFrame:
    """``i, j`` and the sums of every pair with lo <= i < hi and j >= i, per task."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), hi - lo, width - lo))
        for batch in it:
            for start in range(0, batch.num_rows, 4096):
                x = _values(batch.column(0).slice(start, 4096), width)[:, lo:] - shift[lo:]
                here = ~np.isnan(x)
                x = np.where(here, x, 0.0)
                m, square = here.astype("float64"), x * x
                own = slice(0, hi - lo)
                for k, (a, b) in enumerate(((m, m), (x, m), (m, x), (square, m), (m, square), (x, x))):
                    total[k] += a[:, own].T @ b
        i, j = (v.ravel() for v in np.mgrid[lo:hi, lo:width])
        kept = np.flatnonzero((j >= i) & (total[0].ravel() > 0))
        for at in range(0, len(kept), _OUT):
            some = kept[at:at + _OUT]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[some], pa.int32()), pa.array(j[some], pa.int32()), *(pa.array(t.ravel()[some]) for t in total)],
                ["i", "j", *SUMS])

    return rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))


def correlations(rows: DataFrame, names: Sequence[str], values: str | Column | None = None, block: int = 512) -> DataFrame:
    """``a, b, n, r`` for each pair of names once, a name with itself included; a stands before b in ``names``.
    ``values`` is an array column in the order of the names; without it the names are columns."""
    width = len(names)
    array = F.array(*[F.col(c).cast("double") for c in names]) if values is None else (
        F.col(values) if isinstance(values, str) else values)
    # Read once a block of columns, made once.
    data = stage(rows.select(array.cast("array<double>").alias("v")).where("v is not null"), "correlations")
    first = data.first()
    # Sums are taken around one row, so large values lose no digits.
    shift = np.nan_to_num(np.array(first.v if first else [0.0] * width, "float64"))
    if len(shift) != width:
        raise ValueError(f"{width} names for arrays of {len(shift)} values")
    out = None
    for lo in range(0, width, block):
        part = _pair_sums(data, width, lo, min(lo + block, width), shift)
        out = part if out is None else out.unionByName(part)
    sums = out.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    n = F.col("n")
    var_x, var_y = (F.col(f"s{v}{v}") - F.col(f"s{v}") * F.col(f"s{v}") / n for v in "xy")
    # What rounding leaves of the variance of a constant column counts as none.
    flat = (var_x <= F.col("sxx") * 1e-14) | (var_y <= F.col("syy") * 1e-14)
    ratio = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(var_x * var_y)
    r = F.when((n >= 2) & ~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    listed = F.array(*[F.lit(c) for c in names])
    return sums.withColumn("names", listed).select(
        F.col("names")[F.col("i")].alias("a"), F.col("names")[F.col("j")].alias("b"), n.cast("bigint").alias("n"),
        r.alias("r"))
