"""The corpus pipeline: documents in, cleaned and encoded documents out.

Each stage takes all rows its predecessor kept and decides for every row; rows
are told apart by doc_id, or, where doc_ids are null or repeat, by their order.
All stages but the last keep the columns of documents, whichever they are; the
last gives doc_id, n_tokens and the digests of the ids and of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm import bpe, decontaminate, near_copies, resample, substring_dedup
from fernlake.llm.common import free_name, materialise, small_batches, unique_ids, without_keys
from fernlake.llm.queries import TOKENIZERS


def without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Rows whose key is not in gone, without the key.  gone is written first, and only texts that may be in it are dealt out."""
    return without_keys(rows, materialise(gone, "gone"), name).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling does not select go."""
    small_batches(spark)
    name = free_name(docs, "row_id")
    rows = unique_ids(docs, name)
    found = resample.resampled(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), key=name)
    return without(rows, found.where(~F.col("selected")).select(F.col("row_key").alias(name)), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the first document stays."""
    small_batches(spark)
    name = free_name(docs, "row_id")
    rows = unique_ids(docs, name)
    groups = near_copies.near_groups(rows.select(F.col(name).alias("doc_id"), "text"))
    return without(rows, groups.where("doc_id <> component_id").select(F.col("doc_id").alias(name)), name)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of words are cut from the texts."""
    small_batches(spark)
    return substring_dedup.applied(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    small_batches(spark)
    name = free_name(docs, "row_id")
    rows = unique_ids(docs, name)
    found = decontaminate.contained(rows.select(F.col(name).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(rows, found.select(F.col("doc_id").alias(name)), name)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encoded(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmark),
    ("bpe encoding", encode),
]
#: The stages are models, hashes and encoders that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
