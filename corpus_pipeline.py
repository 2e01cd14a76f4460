"""A training-data pipeline over ``documents``: each stage works on all rows that its predecessor kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of
``docs``; the last returns the pieces of the packed sequences. Rows with a
null text have no language and go in the first stage. Rows that share an id are
one document: all of them stay or go in the second stage, by their texts' groups;
rows without an id are none that could stand for another, so they are never
near duplicates. Repeated rows are treated alike in every stage; an empty table
passes through; other columns may have any names. A document that contains a benchmark item goes;
secrets are masked in place, so no document goes for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import decontaminate, language_id, near_dup, packing, secret_scan
from cohortkit.llm.common import bound_batches, crc_remainder, free_name, row_key, small_batches, stage, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learned language; learns outside the held-out remainder as query op9 does.

    The result is read when the caller writes it, so the bound on Arrow batches stays in the session.
    """
    bound_batches(spark)
    model = language_id.fit(docs, crc_remainder(F.col("doc_id"), 4) != 2)
    return language_id.accepted(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least id of each near-duplicate component: five-word shingles, similarity 0.8."""
    kept = near_dup.near_duplicates(docs, n=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold four fifths of a benchmark item's five-word shingles."""
    found = decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"), n=5, percent=80)
    key = free_name(docs, "_key")
    leaked = stage(found.select(F.col("key").alias(key)).distinct(), "leaked")
    return docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(leaked, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets that the forest confirms."""
    return secret_scan.redact(docs, secret_scan.scan(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    with small_batches(spark):  # tokenizing is written in there; what is left for the caller takes no texts
        return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Trained models, component search and tokenization are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
