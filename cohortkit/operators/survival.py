"""Kaplan–Meier, survival at time points, log-rank, concordance index and
exact ROC AUC.

All work on counted rows (per time, or per risk and time), reduced with
partial aggregation, and on ``running_sums`` over them; no pair is formed
and no group is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sums

Z95 = 1.959963984540054  # standard normal quantile at 0.975


def _list(x):
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# --------------------------------------------------------------------------- S1
def kaplan_meier(df: DataFrame, duration: str, event: str, by: str | Sequence[str] | None = None, z: float = Z95) -> DataFrame:
    """Kaplan–Meier table per group and distinct time.

    Columns: ``by..., time, n_at_risk, events, censored, survival, ci_lower,
    ci_upper, var_greenwood``. ``survival`` is 0 from the first time all
    units at risk have the event. CI: exponential Greenwood (log(-log)
    transform); it is [1, 1] while survival is 1 and [0, 0] at 0.

    Running sums (``running_sums``) go over the per-(group, time) table; NULL
    group keys form a group.
    """
    keys = _list(by)
    base = df.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
    per_t = base.groupBy(*keys, F.col(duration).alias("time")).agg(
        F.count(F.lit(1)).alias("n_t"),
        F.sum(F.col(event).cast("long")).alias("events"),
    )
    n = F.col("n_at_risk").cast("double")
    d = F.col("events").cast("double")
    log_term = F.when(d < n, F.log(F.lit(1.0) - d / n)).otherwise(F.lit(0.0))
    dead_term = F.when(d >= n, F.lit(1)).otherwise(F.lit(0))
    gw_term = F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0))
    t = running_sums(per_t, "time", ["n_t"], keys, descending=True).withColumnRenamed("n_t_cum", "n_at_risk")
    t = t.withColumn("__log", log_term).withColumn("__dead", dead_term).withColumn("__gw", gw_term)
    t = running_sums(t, "time", ["__log", "__dead", "__gw"], keys).withColumnRenamed("__gw_cum", "var_greenwood")
    t = t.withColumn("censored", F.col("n_t") - F.col("events")).withColumn(
        "survival", F.when(F.col("__dead_cum") > 0, F.lit(0.0)).otherwise(F.exp(F.col("__log_cum")))
    )
    v = F.log(F.col("survival"))
    inner = F.lit(z) * F.sqrt(F.col("var_greenwood")) / v
    mid = F.log(-v)
    ok = (F.col("survival") > 0) & (F.col("survival") < 1)
    # log(S) < 0, so "mid - inner" is the larger exponent and gives the lower bound
    t = t.withColumn("ci_lower", F.when(ok, F.exp(-F.exp(mid - inner))).otherwise(F.col("survival"))).withColumn(
        "ci_upper", F.when(ok, F.exp(-F.exp(mid + inner))).otherwise(F.col("survival"))
    )
    return t.select(*keys, "time", "n_at_risk", "events", "censored", "survival", "ci_lower", "ci_upper", "var_greenwood")


# --------------------------------------------------------------------------- S2
def survival_at(km: DataFrame, times: Sequence[float], by: str | Sequence[str] | None = None) -> DataFrame:
    """S(t) of a KM table at the given time points (step function; 1.0
    before the first time). One aggregation with a conditional ``max_by``
    per time point, then unpivot: ``(by..., time_point, survival)``."""
    keys = _list(by)
    aggs = []
    for i, tp in enumerate(times):
        hit = F.col("time") <= F.lit(tp)
        aggs.append(F.coalesce(F.max_by(F.when(hit, F.col("survival")), F.when(hit, F.col("time"))), F.lit(1.0)).alias(f"__s{i}"))
    wide = km.groupBy(*keys).agg(*aggs)
    parts = ", ".join(f"CAST({float(tp)!r} AS DOUBLE), `__s{i}`" for i, tp in enumerate(times))
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(times)}, {parts}) as (time_point, survival)")


def at_risk_at(km: DataFrame, times: Sequence[float], by: str | Sequence[str] | None = None) -> DataFrame:
    """Units of a KM table still under observation at the given times
    (duration >= t): ``(by..., time_point, n_at_risk)``."""
    keys = _list(by)
    # risk sets shrink with time, so the largest one from t on is that of the first time >= t
    aggs = [F.coalesce(F.max(F.when(F.col("time") >= F.lit(tp), F.col("n_at_risk"))), F.lit(0)).alias(f"__n{i}") for i, tp in enumerate(times)]
    parts = ", ".join(f"CAST({float(tp)!r} AS DOUBLE), `__n{i}`" for i, tp in enumerate(times))
    return km.groupBy(*keys).agg(*aggs).selectExpr(*[f"`{k}`" for k in keys], f"stack({len(times)}, {parts}) as (time_point, n_at_risk)")


# --------------------------------------------------------------------------- S3
def logrank_stats(df: DataFrame, duration: str, event: str, group: str, group_one: object = 1) -> DataFrame:
    """Two-sample log-rank sums: ``(observed_1, expected_1, variance, chi2)``.

    Per distinct time: E1 = d * n1 / n, V = n1 n0 d (n - d) / (n^2 (n - 1)).
    """
    base = df.where(F.col(duration).isNotNull() & F.col(event).isNotNull() & F.col(group).isNotNull())
    g1 = F.col(group) == F.lit(group_one)
    per_t = base.groupBy(F.col(duration).alias("time")).agg(
        F.count(F.lit(1)).alias("n_t"),
        F.count_if(g1).alias("n1_t"),
        F.sum(F.col(event).cast("long")).alias("d"),
        F.sum(F.when(g1, F.col(event).cast("long")).otherwise(F.lit(0))).alias("d1"),
    )
    t = running_sums(per_t, "time", ["n_t", "n1_t"], descending=True)
    t = t.withColumn("n", F.col("n_t_cum").cast("double")).withColumn("n1", F.col("n1_t_cum").cast("double"))
    d = F.col("d").cast("double")
    n = F.col("n")
    n1 = F.col("n1")
    e1 = d * n1 / n
    var = F.when(n > 1, n1 * (n - n1) * d * (n - d) / (n * n * (n - F.lit(1.0)))).otherwise(F.lit(0.0))
    s = t.agg(F.sum(F.col("d1")).cast("double").alias("observed_1"), F.sum(e1).alias("expected_1"), F.sum(var).alias("variance"))
    diff = F.col("observed_1") - F.col("expected_1")
    return s.withColumn("chi2", F.try_divide(diff * diff, F.col("variance")))


def chi2_1df_pvalue(chi2: float) -> float:
    """Upper tail of chi-square with 1 degree of freedom."""
    if chi2 is None or (isinstance(chi2, float) and math.isnan(chi2)):
        return float("nan")
    return math.erfc(math.sqrt(max(chi2, 0.0) / 2.0))


def logrank(df: DataFrame, duration: str, event: str, group: str, group_one: object = 1) -> DataFrame:
    """Log-rank test: the sums plus ``p_value`` (chi-square, 1 df)."""

    @F.pandas_udf("double")
    def _p(x: pd.Series) -> pd.Series:
        return x.map(chi2_1df_pvalue)

    return logrank_stats(df, duration, event, group, group_one).withColumn("p_value", _p(F.col("chi2")))


# --------------------------------------------------------------------------- C6
def concordance(df: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """Harrell's C for a risk score (higher risk = shorter survival).

    Comparable pair: unit i has the event and unit j lived longer
    (T_j > T_i), or j is censored at the same time. Concordant when
    risk_j < risk_i; equal risk counts 1/2. Output one row:
    ``(c_index, n_comparable, n_concordant, n_tied_risk)``.

    Units are counted by (risk, time, event) first. Two times differ first at
    one bit of their ranks: so each longer-lived pair meets under exactly one
    (bit, higher bits) key, i with the bit off and j with it on, and there a
    running sum over risk counts the units of lower risk. Work is the number
    of distinct rows times the bits of the number of times.
    """
    units = df.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r"))
    units = units.where(F.col("t").isNotNull() & F.col("e").isNotNull() & F.col("r").isNotNull())
    counted = units.groupBy("t", "r").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e") == 1).alias("d"))
    ranks = running_sums(counted.select("t").distinct().withColumn("one", F.lit(1)), "t", ["one"]).select("t", (F.col("one_cum") - 1).alias("rank"))
    bits = int(ranks.agg(F.max("rank")).first()[0] or 0).bit_length()
    rows = counted.join(ranks, "t")
    # level -1 pairs events with units censored at the same time
    level = F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))) if bits else F.lit(-1)
    rows = rows.withColumn("level", level).withColumn("prefix", F.expr("CASE WHEN level < 0 THEN rank ELSE shiftright(rank, level + 1) END"))
    on = F.expr("shiftright(rank, greatest(level, 0)) & 1") == 1
    later = F.when(F.col("level") < 0, F.col("n") - F.col("d")).when(on, F.col("n")).otherwise(F.lit(0))
    dying = F.when((F.col("level") < 0) | ~on, F.col("d")).otherwise(F.lit(0))
    keyed = rows.groupBy("level", "prefix", "r").agg(F.sum(later).alias("later"), F.sum(dying).alias("dying"))
    t = running_sums(keyed, "r", ["later"], ["level", "prefix"])
    big = lambda c: c.cast("decimal(38,0)")
    keys = t.groupBy("level", "prefix").agg(
        F.sum(big(F.col("dying")) * F.col("later")).alias("ties"),
        F.sum(big(F.col("dying")) * (F.col("later_cum") - F.col("later"))).alias("conc"),
        (big(F.sum("dying")) * F.sum("later")).alias("comp"),
    )
    sums = keys.agg(F.sum("conc").alias("n_concordant"), F.sum("ties").alias("n_tied_risk"), F.sum("comp").alias("n_comparable"))
    sums = sums.select(*[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums.columns])
    return sums.select(
        F.try_divide(F.col("n_concordant") + F.lit(0.5) * F.col("n_tied_risk"), F.col("n_comparable")).alias("c_index"), "n_comparable", "n_concordant", "n_tied_risk"
    )


# --------------------------------------------------------------------------- G3
def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact ROC AUC (ties count 1/2): the concordance of the score with a
    two-point "time" that puts negatives after positives."""
    u = df.select(
        (F.lit(1) - F.col(label).cast("int")).alias("__t"),
        F.col(label).cast("int").alias("__e"),
        F.col(score).cast("double").alias("__r"),
    ).where(F.col("__e").isin(0, 1))
    c = concordance(u, "__t", "__e", "__r")
    return c.select(F.col("c_index").alias("auc"), F.col("n_comparable").alias("n_pairs"))
