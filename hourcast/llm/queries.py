"""One query for each operator, over whole tables, and its SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_dir
from . import (cross_tokens, decontaminate, fingerprints, language, mixing, nn_descent, prefix_trie, set_sketch, site_tree,
               token_counts, token_files, url_rules, warc)
from .common import LOWER, UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER, END_ID = "word_bpe_49k.json", 1
PIECES, BYTES, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))
    records = warc.read_archives(spark, files, payloads=False)
    return records.select(
        F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"), "target_uri", F.col("valid").alias("digests_valid"))


@query
def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    rows = token_files.with_starts(token_files.ids_crc32(token_files.read_token_files(spark, path)))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


RULES = (url_rules.Rule("allow", "org", "/"), url_rules.Rule("block", "example.org", "/es/"),
         url_rules.Rule("block", "example.org", "/en/1"), url_rules.Rule("allow", "com", "/fr/"),
         url_rules.Rule("block", "com", "/de/"))


@query
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _op4_sql() -> str:
    def hits(terms):
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in terms)
    rules = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
        for r in sorted(RULES, key=lambda r: (-len(r.text), r.text)))
    verdicts = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in RULES)
    return f"""
WITH p AS (
  SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS u,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, CASE {rules} END AS rule, CAST({hits(url_rules.STRICT)} AS INT) AS n_strict,
             CAST({hits(url_rules.SOFT)} AS INT) AS n_soft FROM p)
SELECT page_id, host, path, rule, n_strict, n_soft,
       CASE rule {verdicts} ELSE CASE WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END END AS verdict
FROM q"""


ORACLES["op4_url_rules"] = _op4_sql()


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()), public_tokenizers.path(PIECES))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return language.predict(rows, model).drop("text")


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return site_tree.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


@query
def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0)


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = set_sketch.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


# Shingles as text; every pair that shares one is counted, which is fit for small tables only.
ORACLES["op7_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
        THEN list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(ws[i:i+4], ' '))
        ELSE [array_to_string(ws, ' ')] END) AS sh FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""


@query
def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op11_exact_duplicates"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
k AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256,
       CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes FROM k"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES),
                                  public_tokenizers.path(PIECES), ranks=public_tokenizers.path(RANKS))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.strings(table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(convs, F.col("conv") - F.col("conv") % 100, head.cast("int")))


# crc32 as a fold over the bytes of the decimal id: a byte is put in, then eight steps of one bit.
ORACLES["op13_prefix_trie"] = """
WITH turns AS (SELECT conv_id, turn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS v FROM conversations
               WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(v ORDER BY turn NULLS FIRST, v.r, v.t) AS vs FROM turns GROUP BY 1),
h AS (SELECT conv_id, vs, CAST(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
          string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END),
        4294967295::BIGINT) % 6 AS BIGINT) AS h FROM own),
s AS (SELECT a.conv_id, list_concat(coalesce(b.vs[1:a.h], []), a.vs[a.h + 1:]) AS vs
      FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
p AS (SELECT conv_id, len(vs) AS n, d, vs[1:d] AS prefix, vs[1:d - 1] AS up
      FROM (SELECT *, unnest(range(0, len(vs) + 1)) AS d FROM s)),
node AS (SELECT prefix, d, any_value(up) AS up, count(*) AS n_convs, min(conv_id) AS conv_id,
                coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
         FROM p GROUP BY prefix, d),
kid AS (SELECT up, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
own_value AS (SELECT node.*, coalesce(n_children, 0) AS n_children,
                     CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[-1].t) END AS saved
              FROM node LEFT JOIN kid ON kid.up = node.prefix),
total AS (SELECT over AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
          FROM (SELECT n_children, saved, prefix[1:unnest(range(0, d + 1))] AS over FROM own_value) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, CASE WHEN v.d > 0 THEN o.conv_id END AS parent_conv_id, v.n_convs, v.n_children,
       t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM own_value v JOIN total t USING (prefix) LEFT JOIN node o ON o.prefix = v.up AND v.d > 0"""
