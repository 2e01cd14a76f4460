"""Bounded, repeatable training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Hash ranges of the first pass over a label.
RANGES = 4096


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int, salt: int) -> DataFrame:
    """At most ``per_label`` distinct keys of each label: those whose hashes are least.

    A label's keys are counted by hash range first, so no label is one task;
    only the ranges that reach the bound are then ranked. The bounds come back
    as one row per label, and the rows are filtered in the scan, so texts of
    other rows are never shuffled. ``rows`` should have few labels. Of rows
    that share a key and label the one least in all columns stays, so two runs
    give the same sample.
    """
    columns = rows.columns
    hashed = rows.filter(F.col(label).isNotNull()).withColumn("_h", F.xxhash64(F.lit(salt), key))
    keys = hashed.select(label, "_h").distinct().withColumn("_r", F.floor(F.col("_h") / F.lit(2.0**64 / RANGES)).cast("int"))
    ranges = keys.groupBy(label, "_r").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(label).orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    # at most RANGES rows of each label
    needed = ranges.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < per_label)
    last = needed.groupBy(label).agg(F.max(F.struct("_r", "before")).alias("m")).select(label, F.col("m._r").alias("_r"), F.col("m.before").alias("before"))
    # the range that holds the bound, ranked alone
    edge = keys.join(F.broadcast(last), [label, "_r"]).withColumn("_k", F.row_number().over(W.partitionBy(label).orderBy("_h")) + F.col("before"))
    bounds = edge.filter(F.col("_k") <= per_label).groupBy(label).agg(F.max("_h").alias("h")).collect()
    if not bounds:
        return rows.limit(0)
    bound = F.create_map(*[F.lit(v) for r in bounds for v in (r[label], r["h"])])
    chosen = hashed.filter(F.col("_h") <= F.element_at(bound, F.col(label)))
    return chosen.groupBy(label, "_h").agg(F.min(F.struct(*columns)).alias("m")).select("m.*")
