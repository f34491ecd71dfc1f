"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison.

A text, its white space runs made one space, is a string of bytes; its fingerprint is the polynomial of these
bytes at a fixed point, modulo two primes. A fingerprint of a whole follows from those of its chunks: each
is shifted by the point to the power of the bytes behind it, and the shifted values add up. Texts up to one
chunk are hashed where they are read; chunks of longer ones are dealt over all tasks and summed.

Rows of equal length and fingerprint are only suspects. The suspect with the smallest id is compared with each of
the others chunk by chunk; those that differ form a new group of suspects, until none is left. A group of any
size is cut into parts of a bounded number of bytes, each with its own copy of the leader's chunk.

Defined results: null counts as empty, and all empty texts are equal; a null id comes after every other id; of
rows with the same id and text one stays; texts of any length are compared whole; an empty table gives no rows;
columns other than the two named are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.chunks import salted_join
from .common import require, staged

# (prime, point) of the polynomials; sums of a chunk of up to 2**24 bytes stay below 2**64.
POLYNOMIALS = ((2147483647, 1103515246), (2147483629, 1664525014))
CHUNK = 1 << 18
PART = 1 << 19
SALTS = 64


def normalised(c: str | Column) -> Column:
    """Runs of ASCII white space become one space, null the empty text. Only runs that are not already one
    space are touched."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


@lru_cache(maxsize=8)
def _powers(prime: int, point: int, size: int) -> np.ndarray:
    """point ** (size - 1), ..., point, 1 modulo the prime."""
    out = np.ones(size, "uint64")
    done = 1
    while done < size:  # doubling: the known powers, shifted by their own number
        more = min(done, size - done)
        out[done:done + more] = out[:more] * np.uint64(pow(point, done, prime)) % np.uint64(prime)
        done += more
    return out[::-1].copy()


def chunk_term(data: np.ndarray, behind: int, prime: int, point: int, size: int = CHUNK) -> int:
    """What a chunk with ``behind`` bytes after it adds to the fingerprint of the whole."""
    own = int(data.astype("uint64") @ _powers(prime, point, size)[size - len(data):]) % prime
    return own * pow(point, behind, prime) % prime


def _terms(chunks: DataFrame, size: int, polynomials: Sequence[tuple[int, int]]) -> DataFrame:
    """``rid, h0, h1`` of rows ``rid, n_bytes, k, chunk``."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rid, n_bytes, k, column = batch.columns
            data, cuts = np.frombuffer(column.buffers()[2] or b"", "uint8"), np.frombuffer(
                column.buffers()[1], "int32")[column.offset:column.offset + len(column) + 1].tolist()
            behind = np.maximum(n_bytes.to_numpy() - (k.to_numpy().astype("int64") + 1) * size, 0).tolist()
            terms = [[chunk_term(data[a:b], after, p, x, size) for a, b, after in zip(cuts, cuts[1:], behind)]
                     for p, x in polynomials]
            yield pa.RecordBatch.from_arrays([rid, *(pa.array(t, pa.int64()) for t in terms)], ["rid", "h0", "h1"])

    return chunks.mapInArrow(run, "rid bigint, h0 bigint, h1 bigint")


def _cut(size: int) -> Column:
    """The chunks of ``body``; one empty chunk of an empty text."""
    return F.expr(f"transform(sequence(0, cast(greatest(n_bytes - 1, 0) div {size} as int)), "
                  f"k -> substring(body, k * {size} + 1, {size}))")


def fingerprints(bodies: DataFrame, size: int = CHUNK,
                 polynomials: Sequence[tuple[int, int]] = POLYNOMIALS) -> DataFrame:
    """``rid, h0, h1`` of rows ``rid, n_bytes, body``."""
    short = bodies.where(F.col("n_bytes") <= size).select("rid", "n_bytes", F.lit(0).alias("k"), F.col("body").alias("chunk"))
    long = (bodies.where(F.col("n_bytes") > size).select("rid", "n_bytes", F.posexplode(_cut(size)).alias("k", "chunk"))
            .repartition("rid", "k"))
    total = [(F.sum(f"h{i}") % F.lit(p)).cast("bigint").alias(f"h{i}") for i, (p, _) in enumerate(polynomials)]
    return (_terms(short, size, polynomials)
            .unionByName(_terms(long, size, polynomials).groupBy("rid").agg(*total)))


def _suspects(todo: DataFrame) -> DataFrame:
    """``rid, leader, leader_id, size`` of the rows that share length and fingerprint with another. Groups are
    counted in salted parts, so a large one is nobody's task."""
    mark = ["n_bytes", "h0", "h1"]
    salted = todo.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    parts = salted.groupBy(*mark, "salt").agg(F.min(first).alias("lead"), F.count(F.lit(1)).alias("size"))
    whole = parts.groupBy(*mark).agg(F.min("lead").alias("lead"), F.sum("size").alias("size")).where("size > 1")
    return (salted.join(parts.select(*mark, "salt").join(whole, mark), [*mark, "salt"])
            .select("rid", "n_bytes", F.col("lead.rid").alias("leader"), F.col("lead.doc_id").alias("leader_id"), "size"))


def _compared(suspects: DataFrame, bodies: DataFrame, size: int) -> DataFrame:
    """Adds ``same``: every chunk equals that of the leader."""
    # Rows of a part: about PART bytes of a chunk, but at least 8, so a leader's copies stay a fraction of them.
    rows = F.greatest(F.lit(PART) / F.least(F.greatest("n_bytes", F.lit(512)), F.lit(size)), F.lit(8))
    parts = F.ceil(F.col("size") / rows).cast("int")
    slots = F.when(F.col("rid") == F.col("leader"), F.sequence(F.lit(0), parts - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("rid"), parts).cast("int")))
    rows = suspects.join(bodies.select("rid", "body"), "rid").withColumn("part", F.explode(slots))
    chunks = rows.select("rid", "leader", "leader_id", "part", F.posexplode(_cut(size)).alias("k", "chunk"))
    # The leader's chunk comes first, the others stream past it.
    stream = (Window.partitionBy("leader", "part", "k").orderBy(F.col("rid") != F.col("leader"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (chunks.withColumn("same", F.first("chunk").over(stream) == F.col("chunk"))
            .groupBy("rid").agg(F.first("leader").alias("leader"), F.first("leader_id").alias("leader_id"),
                                F.bool_and("same").alias("same")))


def _classes(bodies: DataFrame, size: int, polynomials) -> DataFrame:
    """``rid, leader, leader_id`` of rows that were compared with a leader and are equal to it."""
    todo = staged(bodies.select("rid", "doc_id", "n_bytes").join(fingerprints(bodies, size, polynomials), "rid"), "marks")
    found = None
    while True:
        judged = staged(_compared(_suspects(todo), bodies, size), "compared")
        equal = judged.where("same").drop("same")
        found = equal if found is None else found.unionByName(equal)
        other = judged.where("not same").select("rid")
        if other.isEmpty():
            return found
        todo = staged(todo.join(other, "rid", "left_semi"), "marks")


def exact_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = CHUNK,
                     polynomials: Sequence[tuple[int, int]] = POLYNOMIALS) -> DataFrame:
    """One row a row: ``key, keep_id, group_size, kept, text_sha256, n_bytes`` of its normalised text."""
    require(df, [key, text])
    body = normalised(text)
    bodies = staged(df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"),
                              F.octet_length(body).cast("bigint").alias("n_bytes"),
                              F.sha2(body.cast("binary"), 256).alias("text_sha256"), body.cast("binary").alias("body")),
                    "bodies")
    classes = _classes(bodies, size, polynomials)
    sizes = classes.groupBy("leader").agg(F.count(F.lit(1)).alias("group_size"))
    groups = salted_join(classes, sizes, ["leader"], ["rid"], salts=SALTS)
    alone = F.col("leader").isNull()
    return (bodies.select("rid", "doc_id", "n_bytes", "text_sha256").join(groups, "rid", "left")
            .select(F.col("doc_id").alias(key), F.when(alone, F.col("doc_id")).otherwise(F.col("leader_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                    (alone | (F.col("leader") == F.col("rid"))).alias("kept"), "text_sha256", "n_bytes"))
