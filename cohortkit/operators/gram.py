"""Correlations of many columns in one pass: pairwise-complete sums as matrix products.

Each task multiplies its Arrow batches into four p x p sums over the rows where
both columns of a pair are present; tasks are added up in groups, level by
level, until a few partial sums are left for the driver. Columns are shifted by
their means first, so sums of squares keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums added up at once, and left for the driver.
FAN_IN = 16


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """p x p Pearson correlations over pairwise-complete rows; NaN where a pair has fewer than two rows or no variance."""
    cols = list(cols)
    p = len(cols)
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{j}") for j, c in enumerate(cols)])
    # a missing value is NULL for the sums; NaN goes through as it is
    means = x.agg(*[F.avg(f"c{j}").alias(f"c{j}") for j in range(p)]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    present = F.array(*[F.col(f"c{j}").isNotNull() for j in range(p)])
    rows = x.select(F.array(*[F.coalesce(f"c{j}", F.lit(0.0)) for j in range(p)]).alias("v"), present.alias("m"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, p, p))
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.vstack(pdf["m"].to_numpy()).astype(float)
            z = (np.vstack(pdf["v"].to_numpy()) - shift) * m
            total += [m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z]
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [total.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN_IN], "sums": [sum(np.frombuffer(s) for s in pdf["sums"]).tobytes()]})

    left = rows.rdd.getNumPartitions()
    sums = rows.mapInPandas(products, "part long, sums binary")
    while left > FAN_IN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(added, "part long, sums binary")
        left = -(-left // FAN_IN)
    total = sum((np.frombuffer(r["sums"]) for r in sums.collect()), np.zeros(4 * p * p))  # at most FAN_IN rows
    n, sx, sxx, sxy = total.reshape(4, p, p)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = sxy - sx * sx.T / n
        var = np.maximum(sxx - sx * sx / n, 0.0)
        # rounding must not give a constant column a variance
        var[var <= 1e-14 * np.maximum(sxx, 0.0)] = 0.0
        out = cov / np.sqrt(var * var.T)
    out[(n < 2) | (var == 0) | (var.T == 0)] = np.nan
    return np.clip(out, -1.0, 1.0)
