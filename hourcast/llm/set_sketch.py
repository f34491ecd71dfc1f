"""Near duplicates by SetSketch registers: band, estimate jointly, verify on full sets, connect.

A register is floor(1 - log_b of the least of exponentially spaced hashes), cut to 0..q+1: it is merged by
maximum and equal in two sketches about as often as the sets agree. ``bands`` of ``rows`` registers each find
candidates; the joint likelihood of larger, smaller and equal registers, with the known set sizes, estimates
the similarity; what comes near the threshold is verified on the full sets.

No group is compared with itself pair by pair. In each bucket of equal registers every member is compared with
one leader, the member that meets most others. Members that stay outside the leader's component look for
partners in an exact way instead: a partner must hold one of their rarest shingles (how many of them depends on
both sizes), so an inverted index over the members of such buckets finds every remaining link.

Documents with the same set are one class from the start and are never expanded into pairs.

Defined results: a text without words has 0 shingles and its own component. Rows that share an id are one
document and so in one component, whatever their texts. A row without an id takes part; its component is null
unless it is linked with an id, and it is kept if it leads its group. An empty table gives no rows. Ids are
whole numbers below 2^62. Sets are compared as 64-bit shingle hashes, classes by 128 bits.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import free_worker_memory, staged, text_batches
from .components import components
from .shingles import mix, shingle_hashes

REGISTERS, BASE, LIMIT = 128, 1.001, 65534
_SEED = np.random.Generator(np.random.PCG64(20240601))
FACTOR = _SEED.integers(0, 2**32, REGISTERS, dtype="uint64").astype("uint32") | np.uint32(1)
SHIFT = _SEED.integers(0, 2**32, REGISTERS, dtype="uint64").astype("uint32")


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers (texts x REGISTERS) of sets given as hashes, repeats allowed; empty sets have zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, REGISTERS), "uint16")
    if not len(full):
        return out
    x = (hashes >> np.uint64(32)).astype("uint32") ^ hashes.astype("uint32")
    least = np.empty((REGISTERS, len(full)), "uint32")
    work = np.empty_like(x)
    for j in range(REGISTERS):
        np.multiply(x, FACTOR[j], out=work)
        np.add(work, SHIFT[j], out=work)
        np.bitwise_xor(work, work >> np.uint32(15), out=work)
        np.multiply(work, np.uint32(0x2C1B3C6D), out=work)
        least[j] = np.minimum.reduceat(work, offsets[full])
    spaced = -np.log1p(-(least.astype("float64") + 0.5) / 2**32)  # exponential with rate 1
    # A rate of e^12 centres the scale: sets of one to millions of elements stay within 0..q+1.
    value = np.floor(1 - (np.log(spaced) - 40.0) / math.log(BASE))
    out[full] = np.clip(value, 0, LIMIT + 1).astype("uint16").T
    return out


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 200) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    top = np.minimum(u / v, v / u)
    for k in range(steps + 1):
        j = top * k / steps
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        tiny = 1e-12
        score = (more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny))
                 + same * np.log(np.maximum(1 - up - down, tiny)))
        better = score > best
        best, at = np.where(better, score, best), np.where(better, j, at)
    return at


BANDS, ROWS = 32, 4
MARGIN = 0.2  # six standard errors of the estimate at 0.75: nothing near the threshold is given up unverified
BROADCAST_IDS = 1_000_000
BATCH = 4 << 20  # bytes of text that are sketched at once
NO_ID = 1 << 62


def _node(key: str, text: str) -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))


def _sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The set of each text, in order, and 128 bits that stand for it (None: empty)."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:])]
    seeds = np.array([0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D], "uint64")
    names = [np.array([mix(s ^ x).sum(dtype="uint64") for x in seeds], "<u8").tobytes() if len(s) else None for s in sets]
    return sets, names


def sketch_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, node, n, cid, sketch`` of every row; ``cid`` names its shingle set."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_memory()
        for part, words in text_batches(it, size=BATCH):
            hashes, offsets = shingle_hashes(words)
            regs = registers(hashes, offsets)
            sets, names = _sets(hashes, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
                 pa.array([r.astype("<u2").tobytes() for r in regs], pa.binary())], ["doc_id", "node", "n", "cid", "sketch"])

    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("doc_id"), _node(key, text).alias("node"), F.col(text).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, node bigint, n bigint, cid binary, sketch binary"))


def shingle_sets(df: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """``cid, n, shingles`` of the documents with the given nodes, each set once."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_memory()
        for part, words in text_batches(it, size=BATCH):
            sets, names = _sets(*shingle_hashes(words))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("int32")
            flat = np.concatenate(sets).astype("int64") if sets else np.empty(0, "int64")
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(np.diff(offsets), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["cid", "n", "shingles"])

    rows = df.select(_node(key, text).alias("node"), F.col(text).alias("text"))
    nodes = staged(nodes, "sketch-nodes")
    small = nodes.count() <= BROADCAST_IDS  # 8 MB at most; beyond that a join by shuffle
    rows = rows.join(F.broadcast(nodes) if small else nodes, "node", "left_semi")
    return rows.select("text").mapInArrow(run, "cid binary, n bigint, shingles array<bigint>")


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) those whose joint estimate comes near the threshold."""
    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), -1) for s in (a, b))
        return pd.Series(joint_estimate(x, y, na.to_numpy(float), nb.to_numpy(float)))

    left = sketches.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    # Sizes too far apart can't reach the threshold, whatever they share.
    both = both.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return both.where(estimate("sa", "sb", "na", "nb") >= threshold - MARGIN).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those with 100 * intersection >= percent * union."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id, node, n_shingles, component_id, kept`` of every row."""
    threshold = percent / 100
    rows = staged(sketch_documents(df, key, text), "sketch-rows")
    classes = staged(rows.where("n > 0").groupBy("cid").agg(F.min("node").alias("rep"), F.first("n").alias("n")),
                     "sketch-classes")
    named = rows.where("n > 0").select("node", "cid", "sketch").join(classes, "cid")
    sketches = named.where("node = rep").dropDuplicates(["cid"]).select("cid", "rep", "n", "sketch")

    # Buckets of equal registers, band by band; only those with several members go on.
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", 1 + b * width, width)) for b in range(BANDS)])
    bands = sketches.select("cid", F.explode(keys).alias("bucket"))
    several = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(bands.join(several, "bucket"), "sketch-members")
    met = members.select("cid").distinct()
    sketches = staged(sketches.join(met, "cid"), "sketch-candidates")
    sets = staged(shingle_sets(df, sketches.select("rep").distinct().withColumnRenamed("rep", "node"), key, text)
                  .join(met, "cid").dropDuplicates(["cid"]), "sketch-sets")

    # Everyone against the leader of each bucket.
    hub = members.groupBy("cid").agg(F.sum("size").alias("hub"))
    leaders = staged(members.join(hub, "cid").groupBy("bucket").agg(F.max(F.struct("hub", "cid"))["cid"].alias("leader")),
                     "sketch-leaders")
    pairs = (members.join(leaders, "bucket").where("cid <> leader")
             .select(F.least("cid", "leader").alias("a"), F.greatest("cid", "leader").alias("b")).distinct())
    links = staged(_verified(_estimated(pairs, sketches, threshold), sets, percent), "sketch-links")
    rep = classes.select("cid", "rep")

    def as_nodes(pairs: DataFrame) -> DataFrame:
        return (pairs.join(rep.toDF("a", "u"), "a").join(rep.toDF("b", "v"), "b").select("u", "v"))

    # Rows of one id with different texts.
    twice = (named.groupBy("node").agg(F.min("rep").alias("u"), F.max("rep").alias("_m")).where("u <> _m")
             .join(named.select("node", "rep").distinct(), "node").select("u", F.col("rep").alias("v")))
    edges = staged(as_nodes(links).union(twice), "sketch-edges")
    found = staged(components(edges), "sketch-components")

    # Members outside their leader's component, in buckets where not everyone has met everyone.
    comp = (sketches.select("cid", "rep", "n").join(found, F.col("rep") == F.col("node"), "left")
            .select("cid", "n", F.coalesce("component", "rep").alias("comp")))
    comp = staged(comp, "sketch-comp")
    wide = members.where("size > 2").join(comp.select("cid", "comp"), "cid")
    lead = leaders.join(comp.select(F.col("cid").alias("leader"), F.col("comp").alias("lead")), "leader")
    wide = staged(wide.join(lead.select("bucket", "lead"), "bucket"), "sketch-wide")
    apart = wide.where("comp <> lead").select("cid").distinct()
    unsettled = wide.where("comp <> lead").select("bucket").distinct()
    around = wide.join(unsettled, "bucket", "left_semi").select("cid").distinct()
    index = staged(sets.join(around, "cid").join(comp.select("cid", "comp"), "cid")
                   .select("cid", "n", "comp", F.explode("shingles").alias("s")), "sketch-index")
    common = index.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # The k-th rarest shingle of a set of n matters only for partners of m shingles with
    # percent * (n + m) <= (100 + percent) * (n - k + 1): more than n - k + 1 shared shingles include an earlier one.
    mine = index.join(apart, "cid").join(common, "s", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    mine = mine.withColumn("k", F.row_number().over(Window.partitionBy("cid").orderBy("df", "s")))
    mine = mine.where("df > 1").select(
        F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), "s",
        F.floor((100 + percent) * (F.col("n") - F.col("k") + 1) / percent - F.col("n")).alias("most"))
    mine = mine.where(100 * F.col("most") >= percent * F.col("nx"))
    more = (mine.join(index, "s").where((F.col("comp") != F.col("cx")) & (F.col("n") <= F.col("most"))
                                        & (100 * F.least("n", "nx") >= percent * F.greatest("n", "nx")))
            .select(F.least("x", "cid").alias("a"), F.greatest("x", "cid").alias("b")).distinct())
    more = staged(as_nodes(_verified(_estimated(more, sketches, threshold), sets, percent)), "sketch-more")
    if more.limit(1).count():
        found = staged(components(found.toDF("u", "v").union(more)), "sketch-components")

    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        "cid", F.coalesce("component", "rep").alias("comp"))
    out = rows.select("doc_id", "node", "n", "cid").join(of_class, "cid", "left")
    out = out.withColumn("comp", F.coalesce("comp", "node"))
    return out.select("doc_id", "node", F.col("n").alias("n_shingles"),
                      F.when(F.col("comp") < NO_ID, F.col("comp")).alias("component_id"),
                      (F.col("node") == F.col("comp")).alias("kept"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay: one document of each group, and of rows that share its id one."""
    found = staged(near_duplicates(df, key, text, **options), "sketch-found")
    keep = found.where("kept").select(F.col("node").alias("__node")).distinct()
    out = df.withColumn("__node", _node(key, text)).join(keep, "__node", "left_semi")
    if found.groupBy("node").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["__node"])
    return out.select(*df.columns)
