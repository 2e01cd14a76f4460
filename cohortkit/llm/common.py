"""Shared pieces of the training-data operators: word patterns, row keys, staged tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.session import scratch_path

#: Fixed patterns of the query contracts.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
LETTER_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing
    the upstream text passes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def row_key(doc_id: Column, text: Column) -> Column:
    """Deterministic key of a row: stable when a task is run again, defined for null ids."""
    return F.xxhash64(doc_id, text)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def literal_array(values: Sequence, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


#: Bytes of an Arrow batch of texts. A task holds several copies of one, in the JVM and in its Python worker.
BATCH_BYTES = 2 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> bool:
    """From now on Python gets Arrow batches of at most ``BATCH_BYTES``, unless the session has a bound of its own; whether that was set now."""
    if spark.conf.get(_BATCH_KEY, None) is not None:
        return False
    spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return True


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``bound_batches`` for the steps that run inside; the session is then as it was."""
    bound = bound_batches(spark)
    try:
        yield
    finally:
        if bound:
            spark.conf.unset(_BATCH_KEY)


#: Bytes of a table that may be broadcast, and parts that a key is split into where it may not.
BROADCAST, SALTS = 32_000_000, 64


def measured_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the values of ``df``, 16 bytes a column more, are within ``limit`` bytes (``BROADCAST``)."""
    length = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16 * len(df.columns)))
    return (df.agg(F.sum(length)).first()[0] or 0) <= (BROADCAST if limit is None else limit)


def join_small(rows: DataFrame, totals: DataFrame, keys: Sequence[str], spread: Column) -> DataFrame:
    """``rows`` with the columns of ``totals``, one row of which has each of ``keys`` (null is a key like any other).

    ``totals`` is broadcast if its measured size allows it. Otherwise its rows
    are repeated ``SALTS`` times and a key's rows are dealt over them by
    ``spread``, so a key with a third of all rows is not one task.
    """
    totals = stage(totals, "totals")
    values = [c for c in totals.columns if c not in keys]
    right = totals.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    if measured_small(totals):
        joined = rows.join(F.broadcast(right), same)
    else:
        left = rows.withColumn("_salt", F.pmod(spread, F.lit(SALTS)))
        right = right.withColumn("_right_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(right, same & (F.col("_salt") == F.col("_right_salt")))
    return joined.select(*rows.columns, *values)
