"""The registered queries of the operators over text corpora."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    decontaminate, mixing, neardup, nra, quality, rules, secret_scan, substrings, tokenfiles, toxicity,
    vector_graph, warc, whitening)
from larder.llm.tables import read
from larder.session import work_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(read(spark, folder, "documents"), RANKS)


def op2_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.write_and_read(read(spark, folder, "documents"), TOKENIZER,
                                     encoded_bytes=8 << 20)


def op3_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = work_path(spark, "warc")
    warc.write_archives(read(spark, folder, "pages"), archive)

    def page(uri: str) -> Column:
        return F.nullif(F.substring_index(uri, ":", -1), F.lit("")).cast("long")

    return warc.read_archives(spark, archive, payload="false").select(
        page("record_id").alias("page_id"), "payload_bytes",
        F.coalesce("found_digest", "payload_digest").alias("payload_digest"), "record_type",
        page("refers_to").alias("refers_to"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify_toxicity(read(spark, folder, "documents"),
                                      read(spark, folder, "labels"))


def op6_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest_column(
        substrings.remove_repeats(read(spark, folder, "documents")), "kept_text", "kept_sha256")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, folder, "documents"),
                                    read(spark, folder, "benchmark"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan_mix(read(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.apply_rules(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


def op12_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    return vector_graph.near_vectors(read(spark, folder, "embeddings"))


def op13_nra_search(spark: SparkSession, folder: str) -> DataFrame:
    return nra.rank_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_secrets, op2_token_planes, op3_minhash_neardup, op4_warc, op5_toxicity, op6_pu_quality,
    op7_substring_dedup, op8_decontaminate, op9_mixing, op10_quality_rules,
    op11_whitening, op12_vector_graph, op13_nra_search)}
