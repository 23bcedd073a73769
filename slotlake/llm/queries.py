"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake.llm import (
    bpe, compression, hamming_join, language_id, licenses, mixing, near_dup, pii, quality, sharding, spelling, topk, warc,
)
from slotlake.llm.common import table
from slotlake.llm.oracle import ORACLE_SQL as ORACLE_SQL

# The vocabulary of op10; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken_words(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.uniform_tree(40)
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), tree, sharding.grow(tree))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        "region", "rack",
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_hamming_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_join.find_components(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.code_table(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_mix_sources": op3_mix_sources,
    "op4_quality_rules": op4_quality_rules,
    "op5_personal_data": op5_personal_data,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_license_scan": op7_license_scan,
    "op8_hash_tree_shards": op8_hash_tree_shards,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hamming_near_dup": op12_hamming_near_dup,
    "op13_vector_codes": op13_vector_codes,
}
