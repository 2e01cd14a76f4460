"""Cox proportional hazards (Efron ties, L2 penalty), covariate screening,
the scaled-Schoenfeld PH test and risk scores.

The likelihood, its gradient and Hessian come from ``risk_sets``: two passes
over rows that are kept in time order, with no shuffle and no table of times
on the driver, so durations may all be distinct. The driver solves one p x p
system a step.

Objective (the contract of the reference's model): covariates are scaled
with their mean and sample SD, and ``LL - n * penalizer / 2 * ||beta||^2`` is
maximised in that scale; the covariance is the inverse of the negative
penalised Hessian; coefficients and SEs are mapped back to original units.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import correlation_matrix
from .risk_sets import Risk, TimeOrder
from .survival import Z95, chi2_1df_pvalue


@dataclass
class CoxModel:
    covariates: list[str]
    coef: np.ndarray  # original units
    se: np.ndarray
    variance: np.ndarray  # original units
    means: np.ndarray
    sds: np.ndarray
    loglik: float
    n: int
    n_events: int
    steps: int
    penalizer: float
    order: TimeOrder = field(repr=False)
    risk: Risk = field(repr=False)

    @property
    def hazard_ratios(self) -> np.ndarray:
        return np.exp(self.coef)

    def summary_rows(self) -> list[tuple]:
        rows = []
        for j, c in enumerate(self.covariates):
            b, s = float(self.coef[j]), float(self.se[j])
            z = b / s if s > 0 else float("nan")
            p = math.erfc(abs(z) / math.sqrt(2.0)) if s > 0 else float("nan")
            rows.append((c, b, math.exp(b), s, math.exp(b - Z95 * s), math.exp(b + Z95 * s), z, p))
        return rows


SUMMARY_SCHEMA = "covariate string, coef double, hr double, se double, ci_lower double, ci_upper double, z double, p_value double"


def prepare(df: DataFrame, duration: str, event: str, covariates: Sequence[str], rows_per_block: int = 50_000) -> tuple[TimeOrder, np.ndarray, np.ndarray]:
    """Complete rows with scaled covariates (mean / sample SD) in time order."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    cols = list(covariates)
    base = df.select(F.col(duration), F.col(event), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
    row = base.agg(*aggs).first()
    means = np.array([row[f"m_{c}"] for c in cols], float)
    sds = np.array([row[f"s_{c}"] if row[f"s_{c}"] not in (None, 0.0) else 1.0 for c in cols], float)
    zcols = [f"__z_{j}" for j in range(len(cols))]
    scaled = base.select(F.col(duration), F.col(event), *[((F.col(c) - F.lit(float(means[j]))) / F.lit(float(sds[j]))).alias(zcols[j]) for j, c in enumerate(cols)])
    return TimeOrder(scaled, duration, event, zcols, rows_per_block), means, sds


def cox_ph(
    df: DataFrame, duration: str, event: str, covariates: Sequence[str], penalizer: float = 0.1, tol: float = 1e-7, max_steps: int = 50, rows_per_block: int = 50_000
) -> CoxModel:
    """Fit a Cox model with Efron ties; see the module doc for the objective. Rows with a NULL are left out."""
    order, means, sds = prepare(df, duration, event, covariates, rows_per_block)
    p = len(sds)

    def penalised(b: np.ndarray):
        ll, g, h, counts, at = order.terms(b)
        n = counts[0]
        return ll - n * penalizer / 2.0 * float(b @ b), g - n * penalizer * b, h - n * penalizer * np.eye(p), counts, at

    beta = np.zeros(p)
    pll, pg, ph, counts, at = penalised(beta)
    step = 0
    while step < max_steps:
        step += 1
        delta = np.linalg.solve(-ph, pg)
        size = 1.0
        while True:
            cand = beta + size * delta
            found = penalised(cand)
            if np.isfinite(found[0]) and found[0] >= pll - 1e-9 * max(1.0, abs(pll)):
                break
            size /= 2.0
            if size < 1e-6:
                raise RuntimeError(f"Cox fit: no step raises the likelihood (step {step}, gradient norm {np.linalg.norm(pg):.3g})")
        beta, (pll, pg, ph, counts, at) = cand, found
        if np.linalg.norm(size * delta) < tol:
            break
    else:
        raise RuntimeError(f"Cox fit: not converged after {max_steps} steps (gradient norm {np.linalg.norm(pg):.3g})")
    variance = np.linalg.inv(-ph) / np.outer(sds, sds)
    return CoxModel(list(covariates), beta / sds, np.sqrt(np.diag(variance)), variance, means, sds, float(pll), int(counts[0]), int(counts[1]), step, penalizer, order, at)


def cox_at(df: DataFrame, duration: str, event: str, covariates: Sequence[str], coef: Sequence[float], rows_per_block: int = 50_000) -> tuple[CoxModel, np.ndarray]:
    """The unpenalised model with given coefficients (of the covariates as they are), and its score: what one Newton step works on."""
    order, means, sds = prepare(df, duration, event, covariates, rows_per_block)
    coef = np.asarray(coef, float)
    ll, grad, hess, counts, at = order.terms(coef * sds)
    variance = np.linalg.inv(-hess) / np.outer(sds, sds)
    return CoxModel(list(covariates), coef, np.sqrt(np.diag(variance)), variance, means, sds, float(ll), int(counts[0]), int(counts[1]), 0, 0.0, order, at), grad * sds


def cox_summary(spark, model: CoxModel) -> DataFrame:
    """Hazard-ratio table (C7 forest-plot data): one row per covariate."""
    return spark.createDataFrame(model.summary_rows(), SUMMARY_SCHEMA)


# --------------------------------------------------------------------------- C9
def predict_risk(model: CoxModel, out: str = "partial_hazard") -> Column:
    """exp(sum beta_j (x_j - mean_j)) as a generated column expression (no UDF)."""
    lin: Column = F.lit(0.0)
    for j, c in enumerate(model.covariates):
        lin = lin + F.lit(float(model.coef[j])) * (F.col(c).cast("double") - F.lit(float(model.means[j])))
    return F.exp(lin).alias(out)


# --------------------------------------------------------------------------- C5
def schoenfeld_residuals(model: CoxModel, with_covariates: bool = False) -> DataFrame:
    """Residuals of the events: duration, n (events with these values), time_rank, ``r_<c>`` and scaled ``s_<c>`` per covariate,
    with the covariates themselves if wanted.

    Residual: x - (Efron-weighted mean of x at the event's time); scaled by
    n_events * covariance. ``time_rank`` is the average rank of the duration
    among all units. Events are joined to the times in Spark.
    """
    p = len(model.covariates)
    times = model.order.event_times(model.risk, float(model.n))
    events = model.order.rows.filter(F.col("__e") > 0).join(times, "__t")
    raw = [(F.col(f"__z_{j}") - F.col(f"mean_{j}")) * F.lit(float(model.sds[j])) for j in range(p)]
    own = [(F.col(f"__z_{j}") * F.lit(float(model.sds[j])) + F.lit(float(model.means[j]))).alias(c) for j, c in enumerate(model.covariates)]
    out = events.select(F.col("__t").alias("duration"), F.col("__n").alias("n"), "time_rank", *(own if with_covariates else []), *[r.alias(f"r_{c}") for r, c in zip(raw, model.covariates, strict=True)])

    def scaled(k: int) -> Column:
        total: Column = F.lit(0.0)
        for j, c in enumerate(model.covariates):
            total = total + F.col(f"r_{c}") * F.lit(float(model.n_events * model.variance[j, k]))
        return total

    return out.select("*", *[scaled(k).alias(f"s_{c}") for k, c in enumerate(model.covariates)])


def ph_test(model: CoxModel) -> list[tuple[str, float, float]]:
    """Scaled-Schoenfeld test against the rank of time, one row per covariate:
    ``(covariate, test_statistic, p_value)``: sums over ``schoenfeld_residuals``."""
    rows = schoenfeld_residuals(model).withColumn("g", F.col("time_rank") - F.lit((model.n + 1) / 2.0))
    sums = [F.sum("n").alias("d"), F.sum(F.col("n") * F.col("g")).alias("g"), F.sum(F.col("n") * F.col("g") * F.col("g")).alias("gg")]
    for k, c in enumerate(model.covariates):
        s = F.col("n") * F.col(f"s_{c}")
        sums += [F.sum(s).alias(f"s{k}"), F.sum(s * F.col("g")).alias(f"gs{k}")]
    r = rows.agg(*sums).first()
    centre = r["g"] / r["d"]
    spread = r["gg"] - r["d"] * centre**2
    stats = [(r[f"gs{k}"] - centre * r[f"s{k}"]) ** 2 / (model.n_events * model.variance[k, k] * spread) for k in range(len(model.covariates))]
    return [(c, float(x), chi2_1df_pvalue(float(x))) for c, x in zip(model.covariates, stats, strict=True)]


PH_SCHEMA = "covariate string, test_statistic double, p_value double"


# --------------------------------------------------------------------------- C2
def screen_covariates(df: DataFrame, covariates: Sequence[str], duration: str, event: str, max_missing: float = 0.5, max_abs_corr: float = 0.99) -> tuple[DataFrame, list[str], list[tuple[str, str]]]:
    """Covariate screening in the reference's order:

    1. constant (<= 1 distinct non-null value) -> drop
    2. missing share > ``max_missing`` -> drop
    3. median fill of the rest
    4. the later column of any pair with |corr| > ``max_abs_corr`` -> drop
    5. rows with NULL duration or event -> drop
    6. zero variance after that -> drop
    Returns the cleaned frame, kept names and ``[(covariate, reason)]``.
    """
    from .balance import impute_median

    cols = list(covariates)
    x = df.select(*cols, duration, event)
    for c in cols:
        x = x.withColumn(c, F.col(c).try_cast("double"))
    dropped: list[tuple[str, str]] = []
    # "at most one distinct non-null value" is min == max (or all NULL):
    # plain min/max, no distinct aggregation
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.min(F.col(c)).alias(f"__lo{i}"), F.max(F.col(c)).alias(f"__hi{i}"), F.count_if(F.col(c).isNull()).alias(f"__m{i}")]
    r = x.agg(*aggs).first()
    kept = []
    for i, c in enumerate(cols):
        if r[f"__lo{i}"] is None or r[f"__lo{i}"] == r[f"__hi{i}"]:
            dropped.append((c, "constant"))
        else:
            kept.append(c)
    kept2 = []
    for c in kept:
        i = cols.index(c)
        if r["__n"] and r[f"__m{i}"] / r["__n"] > max_missing:
            dropped.append((c, "missing"))
        else:
            kept2.append(c)
    kept = kept2
    if kept:
        x, _ = impute_median(x, kept)
    if len(kept) > 1:
        r = np.abs(correlation_matrix(x, kept))
        to_drop = [b for j, b in enumerate(kept) if (r[:j, j] > max_abs_corr).any()]
        for b in to_drop:
            dropped.append((b, "collinear"))
        kept = [c for c in kept if c not in to_drop]
    x = x.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
    if kept:
        sd = x.agg(*[F.stddev_samp(c).alias(c) for c in kept]).first()
        zero = [c for c in kept if sd[c] is None or sd[c] == 0]
        for c in zero:
            dropped.append((c, "zero_variance"))
        kept = [c for c in kept if c not in zero]
    if not kept:
        raise ValueError("no covariates remain after screening")
    return x.select(*kept, duration, event), kept, dropped
