"""Running (cumulative) sums without a window over a whole group.

Rows are dealt into blocks by ranges of the order column (about
``rows_per_block`` rows each); the block's number is that of its partition, so
no cut points stand in the plan. A window sums inside each (keys, block) and a
second one runs over the blocks' totals, which are a few rows per key. The same
plan serves every size; a small table simply has one block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the result keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def running_sums(
    df: DataFrame, order_col: str, cols: Sequence[str], keys: Sequence[str] = (), descending: bool = False, rows_per_block: int = 500_000, out_suffix: str = "_cum"
) -> DataFrame:
    """Adds ``<col><out_suffix>`` = sum of ``col`` over rows of the same keys
    with ``order_col`` <= (or >= when descending) the current row, current row
    included. ``order_col`` must be numeric, not NULL and unique within keys
    (e.g. a per-time aggregate); keys may be NULL. Types are those of ``sum``.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    keys = list(keys)
    fixed = df.checkpoint(eager=True)
    n_blocks = math.ceil(fixed.count() / rows_per_block)
    block = F.lit(0)
    if n_blocks > 1:
        # written out, as the partition's number must not change when a task runs again
        fixed = fixed.repartitionByRange(n_blocks, F.col(order_col).cast("double")).withColumn("__block", F.spark_partition_id()).checkpoint(eager=True)
        block = F.col("__block")
    rows = fixed.withColumn("__block", (-block if descending else block).cast("int"))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__block").agg(*[F.sum(c).alias(f"__t_{i}") for i, c in enumerate(cols)])
    totals = totals.select(*keys, "__block", *[F.sum(f"__t_{i}").over(before).alias(f"__p_{i}") for i in range(len(cols))])
    joined = null_safe_join(rows, totals, [*keys, "__block"])
    out = [(F.sum(c).over(inside) + F.coalesce(F.col(f"__p_{i}"), F.lit(0))).alias(f"{c}{out_suffix}") for i, c in enumerate(cols)]
    return joined.select(*df.columns, *out)
