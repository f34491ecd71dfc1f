"""A training corpus from ``documents``: each stage reads what the one before has written.

The language stage drops texts without a language (null or no letter) and those in none of the learned ones: noise
and other languages, whose best language explains them worse than evenly likely pieces do, by ``LEAST_GAIN`` nats a
character and ``LEAST_DOUBT`` nats in all (so that a few words too rare to be known are kept); near duplicates leave one document of each group; documents that hold a benchmark
item go; sources are mixed to their weights (a document may come several times, or cut at the edge of its
shard's run of blocks); the last stage writes token files and returns what they hold.

A null or empty text ends at the first stage. Rows that share a doc_id are one document from the second stage
on. Extra columns pass through to the last stage; an empty table gives no rows at any stage.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hourcast.llm import decontaminate, language, mixing, set_sketch, token_files
from hourcast.llm.queries import END_ID, PIECES, TOKENIZER
from hourcast.session import scratch_dir

LEAST_GAIN, LEAST_DOUBT = -0.3, 30.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs, public_tokenizers.path(PIECES))
    judged = language.predict(docs, model, names=("__lang", "__likely", "__gain"))
    foreign = (F.col("__gain") < LEAST_GAIN) & (F.col("__gain") * F.length("text") < -LEAST_DOUBT)
    return judged.where((F.col("__lang") != language.UND) & ~foreign).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return set_sketch.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "corpus-tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path(TOKENIZER), END_ID)
    rows = token_files.with_starts(token_files.ids_crc32(token_files.read_token_files(spark, path)))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language), ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks), ("mixing", mix_sources), ("token_files", write_tokens)]
# Forward scores, sketches and token ids are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
