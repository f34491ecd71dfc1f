"""Token ids as ORC files: integer run lengths, row indexes and Bloom filters on the document id.

Documents are put in ascending id order by a range partitioning, so each file (shard) covers one id range
and its stripe statistics prune a look-up to one file, the row index to a few rows and the Bloom filter to
none if the id is absent. A file row is ``doc_id, shard, token_ids``: the ids of a document with the end id
appended, as an integer list that ORC stores in run lengths. Spark reads the stripes in parallel.

A tokenizer that splits at white space gives a text the ids of its words in turn. The worker therefore
remembers the ids of words: new words of a batch are encoded together, texts are joined from memory.
The memory is a cache; when full it starts anew.

Defined results: a null or empty text has the end id alone; repeated rows are stored once each; a null
doc_id sorts first; an empty table gives no rows. Texts of any length are one row.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Words, text_batches, worker_memory

# Between Latin-1 letters and one last full stop or comma the tokenizer cuts anyway, and it lower-cases.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
CACHE = 400_000
ORC_OPTIONS = {"orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id",
               "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(32 << 20), "compression": "zstd"}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of words, of which the recently used are remembered (two generations: a full one becomes the old one,
    and words found there move up); ``flat[start[i]:start[i] + size[i]]`` are those of the i-th word asked for."""

    def __init__(self, path: str):
        self.tokenizer, self.ids, self.old = _tokenizer(path), {"": b""}, {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, several in one call: the word-end pieces say where each word ends."""
        lines = [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]
        ids = np.fromiter((i for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
                           for i in e.ids), "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # a vocabulary without word ends
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [data[lo:hi] for lo, hi in zip([0, *cuts], cuts)]

    def _learn(self, words: set[str]) -> None:
        plain = {w: (w[:-1].lower(), w[-1]) if w[-1] in ".," else (w.lower(), "")
                 for w in words if _PLAIN.fullmatch(w)}
        odd = list(words.difference(plain))
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.ids[w] = np.array(e.ids, "<u4").tobytes()
        ids = self.ids
        todo = [w for w in {core for core, _ in plain.values()} if w not in ids]
        ids.update(zip(todo, self._encode(todo)))
        for end in ".,":
            ids[end] = np.array(self.tokenizer.encode(end, add_special_tokens=False).ids, "<u4").tobytes()
        ids.update({w: ids[core] + ids[end] for w, (core, end) in plain.items()})

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.ids) > CACHE:
            self.old, self.ids = self.ids, {"": b""}
        new = set(words).difference(self.ids)
        if self.old:
            self.ids.update({w: v for w in new if (v := self.old.get(w)) is not None})
            new.difference_update(self.ids)
        self._learn(new)
        found = [self.ids[w] for w in words]
        for w in [w for w in new if len(w) > 64]:
            self.ids.pop(w, None)
        size = np.fromiter(map(len, found), "int64", len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size

    def encode(self, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, the end id after each, and the offsets of the texts."""
        flat, start, size = self.lookup(words.vocab)
        # The end id is one more word, after the last of each text.
        flat, start, size = np.append(flat, np.uint32(end_id)), np.append(start, len(flat)), np.append(size, 1)
        codes = np.insert(words.codes.astype("int64"), words.offsets[1:], len(words.vocab))
        sizes = size[codes]
        ends = np.cumsum(sizes)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[codes] - ends + sizes, sizes)]
        last = words.offsets[1:] + np.arange(len(words.offsets) - 1)
        return ids, np.concatenate([[0], ends[last]])


def encode_documents(df: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """``doc_id`` and ``token_ids`` of every row, in the order of the rows."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_memory(("ids", tokenizer), lambda: WordEncoder(tokenizer))
        for part, words in text_batches(it, size=8 << 20):
            ids, offsets = encoder.encode(words, end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(ids.astype("int32")))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "token_ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return (df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, token_ids array<int>"))


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id",
                      text: str = "text", shards: int | None = None) -> None:
    """Encode every document and write the shards, ids ascending within and across them."""
    spark = df.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id"))
    (encode_documents(ordered, tokenizer, end_id).select("doc_id", F.spark_partition_id().alias("shard"), "token_ids")
     .write.options(**ORC_OPTIONS).orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; filters on ``doc_id`` reach stripes, row groups and Bloom filters."""
    kind = spark.read.orc(path).schema["doc_id"].dataType.simpleString()
    return spark.read.schema(f"doc_id {kind}, shard int, token_ids array<int>").orc(path)


def ids_crc32(rows: DataFrame) -> DataFrame:
    """``doc_id, shard, n_tokens, ids_crc32`` of stored rows."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(2)
            ids, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.select("doc_id", "shard", "token_ids")
            .mapInArrow(run, f"doc_id {kind}, shard int, n_tokens bigint, ids_crc32 bigint"))


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids of all documents before each one: a sum over the shards before,
    plus a running sum within the shard, which the range partitioning bounds. Equal ids stand in crc order."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # One row a shard, so the one window over all of them stays small.
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inside = (Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.join(before, "shard")
            .withColumn("start", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
            .drop("before"))
