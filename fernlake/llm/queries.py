"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm import bpe, decontaminate, huffman, quality_rules, resample, simhash, substring_dedup, suffix_dedup, token_counts, warc
from fernlake.llm.common import small_batches

#: Where the public vocabulary files are; a parameter of the operators.
TOKENIZERS = os.environ.get("FERNLAKE_TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


#: The pre-token pattern of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = huffman.token_files(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", end_id=2, keep_ids=False)
    return files.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", "gumbel_key", "selected")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


#: Words as runs of letters and digits, A-Z lowered; shingles of five, distinct by document and by item.
OP1 = r"""
WITH w AS (
  SELECT doc_id, NULL AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') AS w FROM documents
  UNION ALL
  SELECT NULL, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') FROM benchmark
), s AS (
  SELECT DISTINCT doc_id, item_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM w)
), n AS (SELECT item_id, count(*) AS n FROM s WHERE item_id IS NOT NULL GROUP BY item_id)
SELECT d.doc_id, b.item_id, count(*) AS n_shared, any_value(n.n) AS n_shingles, count(*) / any_value(n.n) AS containment
FROM s d JOIN s b ON d.s = b.s AND d.doc_id IS NOT NULL AND b.item_id IS NOT NULL JOIN n ON n.item_id = b.item_id
GROUP BY d.doc_id, b.item_id HAVING count(*) >= 0.8 * any_value(n.n)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_token_files, op3_resample, op4_substring_dedup, op5_suffix_dedup, op6_token_counts, op7_warc, op8_simhash, op9_quality_rules, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1}
