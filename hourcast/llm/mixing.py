"""Mix sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets: a source gets its weight's share of all words, at most ``cap`` times its own words; what is cut
off is shared by weight among the rest until none is above. The blocks of the mix go to the sources by
highest quotient target / (2 s + 1), and a source's blocks to its shards in the same way by shard size.
A shard is a seeded hash slice of a source, about ``docs_per_shard`` documents, laid out in seeded order and
cut into blocks; its quota is so many whole passes over it and then a run of blocks from a seeded start.
So no step sorts or sums a whole source in one task, and at most four documents a shard are cut.

Defined results: null text has size 0; sources of size 0 have target 0 and take nothing; a null source is one
source, last in order; an empty table gives no rows; repeated rows count each. Rows that agree in id, source
and size may swap places, which changes no value. The list of sources (not of documents) is one group.
"""
from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, staged, word_count


def sainte_lague(votes: np.ndarray, seats: int, limit: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), at most ``limit`` each; ties go to the first.

    Starts from the rounded shares and moves single seats, which ends where dealing them one by one does.
    """
    votes, limit = np.asarray(votes, float), np.asarray(limit, "int64")
    seats = int(min(seats, limit[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), "int64")
    got = np.minimum(np.where(votes > 0, np.ceil(votes * (seats / votes.sum()) - 0.5), 0), limit).astype("int64")
    spare = seats - int(got.sum())
    if spare > 0:
        heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and got[i] < limit[i]]
        heapq.heapify(heap)
        for _ in range(spare):
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < limit[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif spare < 0:
        heap = [(votes[i] / (2 * got[i] - 1), -i) for i in range(len(votes)) if got[i] > 0]
        heapq.heapify(heap)
        for _ in range(-spare):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i] > 0:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``source, n_docs, source_size, target`` from rows of (source, size): one row a source."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", cap * F.col("source_size"))
    everyone = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumns({
        "total": F.sum("source_size").over(everyone),
        "rank": F.row_number().over(by_ratio),
        "above": F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    # Sources in order of limit / weight: the first that a level of (total - limits before) / weights leaves below
    # its limit sets the level for itself and all after it.
    level = (F.col("total") - F.col("above")) / F.col("rest")
    free = F.when(F.col("limit") > level * F.col("weight"), F.struct(F.col("rank"), level.alias("level")))
    per = per.withColumn("first", F.min(free).over(everyone))
    target = F.when(F.col("rank") >= F.col("first")["rank"], F.col("first")["level"] * F.col("weight"))
    return per.select("source", "n_docs", "source_size", F.coalesce(target, F.col("limit")).alias("target"))


def _same(a: DataFrame, b: DataFrame, *cols: str):
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def plan_mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, block: int = 16,
             docs_per_shard: int = 4000, seed: int = 0, key: str = "doc_id", text: str = "text",
             source: str = "source") -> DataFrame:
    """One row a document: ``doc_id, source, size, text_hash, source_size, target, passes, lo1, hi1, lo2, hi2,
    taken``. The mix takes all words ``passes`` times, and once more those of the two spans (word numbers)."""
    rows = staged(df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"),
                            F.xxhash64(text).alias("text_hash")), "mix-sizes")
    goals = staged(source_targets(rows, weights, cap), "mix-sources")
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    n_shards = F.ceil(F.col("n_docs") / docs_per_shard)
    rows = (rows.join(goals, _same(rows, goals, "source"), "left").drop(goals["source"])
            .withColumn("order", order)
            .withColumn("shard", F.pmod(F.xxhash64("order"), n_shards).cast("int")))

    cells = (rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("target").alias("target"),
                                                 F.first("source_size").alias("source_size"))
             .withColumn("n_blocks", F.ceil(F.col("shard_size") / block)))

    def to_sources(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
        seats = int(round(pdf["source_size"].sum() / block))
        return pdf[["source"]].assign(quota=sainte_lague(pdf["target"], seats, cap * pdf["n_blocks"]))

    def to_shards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        quota = sainte_lague(pdf["shard_size"], int(pdf["quota"].iloc[0]), cap * pdf["n_blocks"])
        return pdf[["source", "shard", "shard_size", "n_blocks"]].assign(quota=quota)

    kind = df.schema[source].dataType.simpleString()
    per = cells.groupBy("source").agg(F.sum("n_blocks").alias("n_blocks"), F.first("target").alias("target"),
                                      F.first("source_size").alias("source_size"))
    quotas = per.groupBy().applyInPandas(to_sources, f"source {kind}, quota bigint")
    cells = cells.join(quotas, _same(cells, quotas, "source")).drop(quotas["source"])
    shards = staged(cells.groupBy("source").applyInPandas(
        to_shards, f"source {kind}, shard int, shard_size bigint, n_blocks bigint, quota bigint"), "mix-quotas")

    rows = rows.join(shards, _same(rows, shards, "source", "shard"), "left").drop(shards["source"]).drop(shards["shard"])
    inside = (Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size", "text_hash")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.sum("size").over(inside) - F.col("size")
    whole = F.greatest(F.col("shard_size"), F.lit(1))
    words = F.least(F.col("quota") * block, cap * F.col("shard_size"))
    first = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.greatest(F.col("n_blocks"), F.lit(1))) * block
    size, zero = F.col("size"), F.lit(0).cast("bigint")

    def within(lo, hi):  # the part of the run from word lo to word hi that lies in the document
        a = F.least(F.greatest(lo - F.col("at"), zero), size)
        return a, F.greatest(F.least(hi - F.col("at"), size), a)

    # The run begins at a block's edge and goes on from the shard's first word after its last.
    lo1, hi1 = within(F.col("first"), F.col("first") + F.col("extra"))
    lo2, hi2 = within(zero, F.col("first") + F.col("extra") - F.col("whole"))
    rows = rows.withColumns({"at": at, "first": first, "whole": whole, "words": words}).withColumns({
        "passes": F.floor(F.col("words") / F.col("whole")), "extra": F.pmod(F.col("words"), F.col("whole"))})
    rows = rows.withColumns({"lo1": lo1, "hi1": hi1, "lo2": lo2, "hi2": hi2})
    taken = (F.col("passes") * size + F.col("hi1") - F.col("lo1") + F.col("hi2") - F.col("lo2")).cast("bigint")
    return rows.select("doc_id", "source", "size", "text_hash", "source_size", "target", "passes", "lo1", "hi1", "lo2",
                       "hi2", taken.alias("taken"))


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for each pass and one for each cut piece (its words,
    joined by spaces). Documents that the mix does not take are gone. ``n_chars`` is renewed if there."""
    key, text, source = (options.get(k, d) for k, d in (("key", "doc_id"), ("text", "text"), ("source", "source")))
    plan = plan_mix(df, **options).where("taken > 0")
    piece = F.array(F.struct(F.col("lo1").alias("lo"), F.col("hi1").alias("hi")),
                    F.struct(F.col("lo2").alias("lo"), F.col("hi2").alias("hi")))
    whole = F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("size").alias("hi")),
                           F.col("passes").cast("int"))
    plan = plan.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("text_hash").alias("__mix_hash"),
                       F.col("size").alias("__mix_size"),
                       F.explode(F.concat(whole, F.filter(piece, lambda p: p["hi"] > p["lo"]))).alias("__mix_part"))
    docs = df.withColumn("__mix_key", F.xxhash64(text)).dropDuplicates([key, source, "__mix_key"])
    out = docs.join(plan, docs[key].eqNullSafe(plan["__mix_id"]) & docs[source].eqNullSafe(plan["__mix_source"])
                    & (docs["__mix_key"] == plan["__mix_hash"]))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                               (F.col("__mix_part.lo") + 1).cast("int"), (F.col("__mix_part.hi") - F.col("__mix_part.lo")).cast("int")), " ")
    is_whole = F.col("__mix_part.hi") - F.col("__mix_part.lo") == F.col("__mix_size")
    out = out.withColumn(text, F.when(is_whole, F.col(text)).otherwise(cut))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(is_whole, F.col("n_chars")).otherwise(F.char_length(text)))
    return out.select(*df.columns)
