"""The registered queries of this package: thin forms of its operators over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import language, line_dedup, mixing, packing, quality, secret_scan, simhash, token_counts, topk, warc_index
from quernel.llm.common import documents


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # The table has no capture times: a second per id, from a fixed start.
    captured_at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    return warc_index.archive_and_index(pages, captured_at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.learn(docs))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, max_bits=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_shared")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return edited.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_index, op2_source_mix, op3_language, op4_top_k, op5_simhash, op6_secrets, op7_packing, op8_token_counts, op9_line_dedup, op10_quality)
}

#: Queries without an entry cannot be put in SQL; the tests hold them against brute force, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": warc_index.SQL,
    "op4_top_k": topk.SQL,
    "op6_secrets": secret_scan.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_quality": quality.SQL,
}
