"""Small helpers the operators of this subpackage share."""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_dir

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: str | Column) -> Column:
    """A-Z to a-z; every other letter stays as it is."""
    return F.translate(F.col(c) if isinstance(c, str) else c, UPPER, LOWER)


def word_count(c: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(c) if isinstance(c, str) else c, F.lit(WORD)), F.lit(0)).cast("bigint")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write once under the shared checkpoint folder, read back: cuts lineage and fixes row order."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict = {}


def worker_memory(key, make: Callable[[], object]):
    """What a worker process remembers from task to task. It serves one operator at a time, so only the last one's
    memory is held."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def free_worker_memory() -> None:
    """For operators that remember nothing: what the last one remembered goes, back to the system as far as it can."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


class Words:
    """The words of a batch of texts: ``vocab[codes[offsets[i]:offsets[i + 1]]]`` are those of text i."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        offsets, codes = lists.offsets.to_numpy().astype("int64"), coded.indices.to_numpy(zero_copy_only=False)
        self.vocab: list[str] = coded.dictionary.to_pylist()
        offsets = offsets - offsets[0]
        if "" in self.vocab:  # what stands before leading and after trailing white space
            kept = codes != self.vocab.index("")
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
            codes = codes[kept]
        self.offsets, self.codes = offsets, codes

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text the sum of a value (or row of values) that each word of ``vocab`` has."""
        if values.ndim > 1:  # column by column: one number a word is held at a time
            return np.stack([self.sums(values[:, j]) for j in range(values.shape[1])], axis=1)
        out, full = np.zeros(len(self.offsets) - 1, values.dtype), np.flatnonzero(np.diff(self.offsets))
        if len(full):
            out[full] = np.add.reduceat(values[self.codes], self.offsets[:-1][full])
        return out


def text_batches(it: Iterator[pa.RecordBatch], text: str = "text",
                 size: int = 16 << 20) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of Arrow batches with about ``size`` bytes of text each, and their words; a longer text stays
    whole and alone."""
    for batch in it:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        block = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) // size
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            part = batch.slice(lo, hi - lo)
            yield part, Words(part.column(batch.schema.get_field_index(text)))


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
