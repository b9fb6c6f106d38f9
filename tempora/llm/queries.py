"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, capfilter, langid, linededup, packing, sharding, simhash, suffixarray, toxicity, vptree
from tempora.llm.common import table

SHARDS = 24


def op1_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixarray.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simhash_anchor_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_spherical_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op6_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_bpe_monoid_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.uniform_shards(table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_line_dedup_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_vantage_point_search, op2_suffix_array_dedup, op3_string_kernel_toxicity, op4_simhash_anchor_covering, op5_spherical_cap_dedup, op6_hierarchical_packing, op7_bpe_monoid_tree, op8_hypergeometric_sharding, op9_line_dedup_perfect_hash, op10_crf_language_id]
    return {f.__name__: f for f in found}


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), spread AS (
  SELECT key, count(DISTINCT doc_id) AS n_docs, max(doc_id) AS last_doc
  FROM keyed WHERE length(key) >= 40 GROUP BY key
), judged AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(s.n_docs >= 5 AND s.last_doc <> k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN spread s ON s.key = k.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup_perfect_hash": OP9_SQL}
