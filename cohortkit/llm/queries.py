"""Registered queries of the training-data operators, with their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import (
    decontaminate,
    language_id,
    license_scan,
    near_dup,
    oracles,
    packing,
    piece_codec,
    prefix_audit,
    quality_divergence,
    secret_scan,
    slot_shards,
    suffix_dedup,
    toxicity,
    vector_codes,
)
from cohortkit.llm.common import table


def op1_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_divergence.quality_verdicts(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 4).alias("char_distance"), F.round("word_distance", 4).alias("word_distance"),
    )


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = slot_shards.shard_documents(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version"
    )


def op3_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op4_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "word_no", F.length("value").cast("long").alias("length"), F.crc32("value").alias("value_crc32"), F.round("score", 4).alias("score"), "secret"
    )


def op6_fuzzy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op8_bayesian_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op9_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_decode(table(spark, sf_dir, "documents"))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hadamard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    coded = vector_codes.with_label_error(coded)
    return coded.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_prefix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_audit.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_divergence_quality": op1_divergence_quality,
    "op2_virtual_slots": op2_virtual_slots,
    "op3_sparse_suffixes": op3_sparse_suffixes,
    "op4_shortest_pack_first": op4_shortest_pack_first,
    "op5_forest_secrets": op5_forest_secrets,
    "op6_fuzzy_toxicity": op6_fuzzy_toxicity,
    "op7_minhash_containment": op7_minhash_containment,
    "op8_bayesian_near_dup": op8_bayesian_near_dup,
    "op9_hierarchical_language": op9_hierarchical_language,
    "op10_license_templates": op10_license_templates,
    "op11_piece_table": op11_piece_table,
    "op12_hadamard_codes": op12_hadamard_codes,
    "op13_prefix_audit": op13_prefix_audit,
}

SQL: dict[str, str] = {
    "op1_divergence_quality": oracles.QUALITY,
    "op3_sparse_suffixes": oracles.PASSAGES,
    "op7_minhash_containment": oracles.CONTAINED,
    "op8_bayesian_near_dup": oracles.NEAR_DUPLICATES,
    "op10_license_templates": oracles.LICENSES,
    "op12_hadamard_codes": oracles.VECTOR_CODES,
    "op13_prefix_audit": oracles.SOURCE_AUDIT,
}
