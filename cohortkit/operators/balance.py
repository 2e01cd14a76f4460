"""Covariate balance and preprocessing: SMD tables, median imputation,
one-hot encoding, common-support trimming and the matching caliper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import logit
from .quantiles import exact_quantiles


# --------------------------------------------------------------------------- B1
def smd_table(df: DataFrame, cols: Sequence[str], treat: str = "treatment_group") -> DataFrame:
    """Absolute standardised mean difference per covariate, one pass.

    ``smd = |mean1 - mean0| / sqrt((var1 + var0) / 2)`` with sample variances
    over non-null values; NULL when the pooled SD is 0. Output:
    ``(covariate, treated_mean, control_mean, treated_n, control_n, smd)``
    sorted by smd descending. All covariates are aggregated side by side in
    one wide aggregation (no row-multiplying unpivot of the input); only the
    one-row result is stacked.
    """
    t1 = F.col(treat) == 1
    t0 = F.col(treat) == 0
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [
            F.avg(F.when(t1, v)).alias(f"m1_{i}"),
            F.avg(F.when(t0, v)).alias(f"m0_{i}"),
            F.count(F.when(t1, v)).alias(f"n1_{i}"),
            F.count(F.when(t0, v)).alias(f"n0_{i}"),
            F.var_samp(F.when(t1, v)).alias(f"v1_{i}"),
            F.var_samp(F.when(t0, v)).alias(f"v0_{i}"),
        ]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', m1_{i}, m0_{i}, n1_{i}, n0_{i}, v1_{i}, v0_{i}" for i, c in enumerate(cols))
    long = wide.selectExpr(f"stack({len(cols)}, {parts}) as (covariate, treated_mean, control_mean, treated_n, control_n, __v1, __v0)")
    pooled = F.sqrt((F.col("__v1") + F.col("__v0")) / F.lit(2.0))
    out = long.withColumn("smd", F.abs(F.col("treated_mean") - F.col("control_mean")) / F.nullif(pooled, F.lit(0.0)))
    return out.drop("__v1", "__v0").orderBy(F.col("smd").desc_nulls_last(), "covariate")


def love_plot(smd: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Love-plot data from an SMD table: ``covariate, smd, above_threshold``."""
    return smd.select("covariate", "smd", (F.col("smd") > F.lit(threshold)).alias("above_threshold"))


# --------------------------------------------------------------------------- B2 / B3
def balance_table(before: DataFrame, after: DataFrame, cols: Sequence[str], treat: str = "treatment_group", threshold: float = 0.1) -> DataFrame:
    """SMD and arm means before vs after matching, with the balance flag.

    Output: ``(covariate, mean_treated_before, mean_control_before,
    smd_before, mean_treated_after, mean_control_after, smd_after,
    balanced_after)``; ``balanced_after`` = smd_after < threshold (love-plot data).
    """
    b = smd_table(before, cols, treat).select(
        "covariate",
        F.col("treated_mean").alias("mean_treated_before"),
        F.col("control_mean").alias("mean_control_before"),
        F.col("smd").alias("smd_before"),
    )
    a = smd_table(after, cols, treat).select(
        "covariate",
        F.col("treated_mean").alias("mean_treated_after"),
        F.col("control_mean").alias("mean_control_after"),
        F.col("smd").alias("smd_after"),
    )
    return b.join(a, "covariate", "full").withColumn("balanced_after", F.col("smd_after") < F.lit(threshold)).orderBy(F.col("smd_before").desc_nulls_last(), "covariate")


# --------------------------------------------------------------------------- M1
def medians(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> dict[str, float | None]:
    """Exact medians (linear interpolation) of each column, or ``percentile_approx`` with ``accuracy``."""
    if accuracy is None:
        got = {r["column"]: r["q_0"] for r in exact_quantiles(df, cols, [0.5]).collect()}  # one row per column
        return {c: got.get(c) for c in cols}
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in cols]).first()
    return {c: (None if row[c] is None else float(row[c])) for c in cols}


def impute_median(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> tuple[DataFrame, dict[str, float | None]]:
    """Fill NULLs with the column median; returns the frame and the medians used.

    Imputed columns become double (as a float imputer would return).
    """
    med = medians(df, cols, accuracy)
    out = df
    for c in cols:
        fill = F.lit(med[c]).cast("double")
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), fill))
    return out, med


# --------------------------------------------------------------------------- M2
def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True, levels: dict[str, Sequence[object]] | None = None) -> tuple[DataFrame, list[str]]:
    """Dummy columns ``<col>_<level>`` (double 0/1) for each categorical column.

    Levels are the sorted distinct non-null values of the data, or the sorted
    values given in ``levels`` (e.g. the rows of a dimension table, so the
    output columns do not depend on which levels a sample happens to hold);
    with ``drop_first`` the first level is the reference. NULL gives all
    zeros. The original columns are kept. Returns the frame and the new
    column names.
    """
    out = df
    new_cols: list[str] = []
    for c in cols:
        if levels is not None and c in levels:
            lv = sorted(set(v for v in levels[c] if v is not None))
            for lvl in lv[1:] if drop_first else lv:
                name = f"{c}_{lvl}"
                out = out.withColumn(name, F.when(F.col(c) == F.lit(lvl), F.lit(1.0)).otherwise(F.lit(0.0)))
                new_cols.append(name)
            continue
        levels_c = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()]
        for lvl in levels_c[1:] if drop_first else levels_c:
            name = f"{c}_{lvl}"
            out = out.withColumn(name, F.when(F.col(c) == F.lit(lvl), F.lit(1.0)).otherwise(F.lit(0.0)))
            new_cols.append(name)
    return out, new_cols


# --------------------------------------------------------------------------- M3
def support_bounds(df: DataFrame, score: str, treat: str = "treatment_group") -> tuple[float, float]:
    """Common support ``[max of arm minima, min of arm maxima]``."""
    r = df.agg(
        F.min(F.when(F.col(treat) == 1, F.col(score))).alias("t_min"),
        F.max(F.when(F.col(treat) == 1, F.col(score))).alias("t_max"),
        F.min(F.when(F.col(treat) == 0, F.col(score))).alias("c_min"),
        F.max(F.when(F.col(treat) == 0, F.col(score))).alias("c_max"),
    ).first()
    if None in (r["t_min"], r["c_min"], r["t_max"], r["c_max"]):
        return float("nan"), float("nan")  # an arm is empty: no common support
    return max(r["t_min"], r["c_min"]), min(r["t_max"], r["c_max"])


def trim_common_support(df: DataFrame, score: str, treat: str = "treatment_group") -> tuple[DataFrame, tuple[float, float]]:
    """Keep rows whose score lies in the common support (inclusive)."""
    lo, hi = support_bounds(df, score, treat)
    if lo != lo or hi != hi:  # NaN bounds select nothing
        return df.where(F.lit(False)), (lo, hi)
    return df.where(F.col(score).between(F.lit(lo), F.lit(hi))), (lo, hi)


# --------------------------------------------------------------------------- M6
def caliper(df: DataFrame, score: str, k: float = 0.2, on_logit: bool = True) -> float:
    """``k`` times the sample SD of logit(score) (or of the score itself)."""
    x = logit(F.col(score)) if on_logit else F.col(score)
    sd = df.agg(F.stddev_samp(x).alias("sd")).first()["sd"]
    return float("nan") if sd is None else float(k * sd)


def caliper_frame(df: DataFrame, score: str, k: float = 0.2) -> DataFrame:
    """One row ``(n, sd_logit, caliper)`` computed in Spark."""
    x = logit(F.col(score))
    return df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd_logit")).withColumn("caliper", F.col("sd_logit") * F.lit(k))
