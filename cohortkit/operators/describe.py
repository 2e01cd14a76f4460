"""Descriptive reports: value counts, group rates, describe, cross tables,
histograms, correlations, extreme rows, sign shares and top-k.

All are aggregations with map-side partial combine; only the small report
leaves the executors. Quantiles are exact and never gather a group's values;
pass ``accuracy`` for ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gram import correlation_matrix
from .quantiles import exact_quantiles
from .running import null_safe_join


def _list(x: str | Sequence[str] | None) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# --------------------------------------------------------------------------- A7
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``(col, n)`` sorted by n descending (NULL kept as its own value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col))


# --------------------------------------------------------------------------- A8
def rate_by_group(df: DataFrame, by: str | Sequence[str], y: str) -> DataFrame:
    """``(by..., n_events, n, rate)``: sum, non-null count and mean of ``y``."""
    return df.groupBy(*_list(by)).agg(
        F.sum(F.col(y)).cast("double").alias("n_events"),
        F.count(F.col(y)).alias("n"),
        F.avg(F.col(y)).alias("rate"),
    )


# --------------------------------------------------------------------------- A9
def describe(df: DataFrame, cols: Sequence[str], by: str | Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """count, mean, sample SD, min, quartiles, max per column (and group).

    Moments come from one wide aggregation over all columns side by side,
    quartiles (linear between order statistics, the pandas rule) from
    ``exact_quantiles``; ``accuracy`` gives ``percentile_approx`` instead.
    NULL group keys form a group.
    """
    by = _list(by)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n_{i}"), F.avg(v).alias(f"m_{i}"), F.stddev_samp(v).alias(f"s_{i}"), F.min(v).alias(f"lo_{i}"), F.max(v).alias(f"hi_{i}")]
        if accuracy is not None:
            aggs.append(F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).cast("array<double>").alias(f"q_{i}"))
    wide = df.groupBy(*by).agg(*aggs)
    quartiles = ", q_{0}" if accuracy is not None else ""
    parts = ", ".join(f"'{c}', n_{i}, m_{i}, s_{i}, lo_{i}, hi_{i}" + quartiles.format(i) for i, c in enumerate(cols))
    names = "column, count, mean, std, min, max" + (", __q" if accuracy is not None else "")
    long = wide.selectExpr(*[f"`{b}`" for b in by], f"stack({len(cols)}, {parts}) as ({names})")
    if accuracy is None:
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], by=by).withColumnsRenamed({"q_0": "q25", "q_1": "median", "q_2": "q75"})
        long = null_safe_join(long, q, [*by, "column"], "left")
    else:
        long = long.withColumns({name: F.col("__q")[k] for k, name in enumerate(("q25", "median", "q75"))})
    return long.select(*by, "column", "count", "mean", "std", "min", "q25", "median", "q75", "max")


# --------------------------------------------------------------------------- A12
def crosstab_pct(df: DataFrame, row: str, col: str) -> DataFrame:
    """Long cross table normalised by column: ``(row, col, n, pct)``, pct in 0..100.

    Rows with a NULL in either variable are left out (pandas ``crosstab``).
    """
    counts = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(col)
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / F.sum("n").over(w))


# --------------------------------------------------------------------------- A13
def histogram(df: DataFrame, col: str, by: str | None = None, bins: int = 30) -> DataFrame:
    """Density histogram with ``bins`` equal bins over each group's own range.

    Output ``(by, bin, lo, hi, n, density)`` for every bin (empty bins give 0);
    density = n / (group non-null count * bin width). A constant group uses
    the range [v - 0.5, v + 0.5] like NumPy. NULL values are ignored.
    """
    keys = _list(by)
    x = df.select(*keys, F.col(col).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    stats = x.groupBy(*keys).agg(F.min("__x").alias("__mn"), F.max("__x").alias("__mx"), F.count(F.lit(1)).alias("__cnt"))
    stats = (
        stats.withColumn("__lo", F.when(F.col("__mx") > F.col("__mn"), F.col("__mn")).otherwise(F.col("__mn") - 0.5))
        .withColumn("__hi", F.when(F.col("__mx") > F.col("__mn"), F.col("__mx")).otherwise(F.col("__mx") + 0.5))
        .withColumn("__w", (F.col("__hi") - F.col("__lo")) / F.lit(float(bins)))
    )
    if keys:
        # one stats row per group: broadcast once the group count is checked,
        # so a hot group is not funnelled through one join partition
        n_groups = stats.count()
        binned = x.join(F.broadcast(stats) if n_groups <= 100_000 else stats, on=keys, how="inner")
    else:
        # one group: its range is two scalars
        r = stats.first()
        binned = x.select("__x", *[F.lit(r[c]).alias(c) for c in ("__lo", "__hi", "__w", "__cnt")])
    binned = binned.withColumn(
        "bin",
        F.least(F.floor((F.col("__x") - F.col("__lo")) * F.lit(float(bins)) / (F.col("__hi") - F.col("__lo"))), F.lit(bins - 1)).cast("long"),
    )
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = grid.join(counts, on=[*keys, "bin"], how="left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long"))
    return out.select(
        *keys,
        "bin",
        (F.col("__lo") + F.col("bin") * F.col("__w")).alias("lo"),
        (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("hi"),
        "n",
        (F.col("n") / (F.col("__cnt") * F.col("__w"))).alias("density"),
    )


# --------------------------------------------------------------------------- A15
def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation for each pair (upper triangle): ``(col_a, col_b, corr)``.

    Pairwise-complete rows, one pass for all pairs (``gram``); NULL where a
    pair has no correlation.
    """
    cols = list(cols)
    if len(cols) < 2:
        raise ValueError("need at least two columns")
    r = correlation_matrix(df, cols)
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


# --------------------------------------------------------------------------- A16
def extreme_rows(df: DataFrame, id_col: str, score: str) -> DataFrame:
    """Rows with the highest and the lowest score: ``(which, id, score)``.

    Ties go to the lowest id. Two hash aggregations, no sort: the extreme
    scores (two scalars), then the lowest id at each of them.
    """
    s = F.col(score)
    r = df.agg(F.max(s).alias("hi"), F.min(s).alias("lo")).first()
    res = df.agg(
        F.min(F.when(s == F.lit(r["hi"]), F.col(id_col))).alias("__hi_id"),
        F.min(F.when(s == F.lit(r["lo"]), F.col(id_col))).alias("__lo_id"),
    ).select("__hi_id", F.lit(r["hi"]).cast("double").alias("__hi"), "__lo_id", F.lit(r["lo"]).cast("double").alias("__lo"))
    return res.selectExpr(f"stack(2, 'highest', `__hi_id`, `__hi`, 'lowest', `__lo_id`, `__lo`) as (which, {id_col}, {score})")


# --------------------------------------------------------------------------- A17
def sign_summary(df: DataFrame, col: str) -> DataFrame:
    """``(n, mean, n_pos, n_neg, share_pos, share_neg)`` of a column."""
    c = F.col(col)
    n = F.count(c)
    return df.agg(
        n.alias("n"),
        F.avg(c).alias("mean"),
        F.count_if(c > 0).alias("n_pos"),
        F.count_if(c < 0).alias("n_neg"),
        F.try_divide(F.count_if(c > 0), n).alias("share_pos"),
        F.try_divide(F.count_if(c < 0), n).alias("share_neg"),
    )


# --------------------------------------------------------------------------- T3
def top_k(df: DataFrame, order_col: str, k: int, tiebreak: str | Sequence[str] | None = None) -> DataFrame:
    """The k rows with the largest ``order_col`` (ties by the ``tiebreak`` columns ascending)."""
    order = [F.col(order_col).desc(), *[F.col(c).asc() for c in _list(tiebreak)]]
    return df.orderBy(*order).limit(k)
