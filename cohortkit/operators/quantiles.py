"""Exact quantiles without holding a whole group in one task.

Values are first counted (a heavy repeated value becomes one row), the counts
are summed up in value order with ``running_sums`` and each quantile is read
off at its two ranks. Quantiles interpolate linearly between the order
statistics at floor/ceil of ``(n - 1) * p`` (the rule of ``percentile`` and
pandas). One plan at every size; NULL group keys form a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import null_safe_join, running_sums


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), rows_per_block: int = 500_000) -> DataFrame:
    """``(by..., column, q_0, q_1, ...)``: exact linear-interpolated quantiles
    of each column (NULLs ignored) per group; one output column per prob."""
    keys = [*by, "column"]
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sums(counts, "value", ["__n"], keys, rows_per_block=rows_per_block)
    last = ranked.groupBy(*keys).agg(F.max("__n_cum").alias("__total"))
    rows = null_safe_join(ranked, last, keys)
    at = lambda rank: F.min(F.when(F.col("__n_cum") > rank, F.col("value")))  # noqa: E731  the value of a 0-based rank
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("__total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"__lo_{i}"), at(F.ceil(pos)).alias(f"__hi_{i}"), F.max(pos - F.floor(pos)).alias(f"__w_{i}")]
    out = rows.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[(F.col(f"__lo_{i}") + F.col(f"__w_{i}") * (F.col(f"__hi_{i}") - F.col(f"__lo_{i}"))).alias(f"q_{i}") for i in range(len(probs))])
