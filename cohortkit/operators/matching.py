"""Propensity scores (Spark ML logistic regression) and exact greedy 1:1
nearest-neighbour matching on the logit score, without replacement.

Greedy matching looks sequential: treated units are taken in ascending
score order and each takes the nearest free control within the caliper.
``score_line`` runs it as parallel chunks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import logit
from .score_line import match_line, strata, walk


# --------------------------------------------------------------------------- M4
def standardize(df: DataFrame, cols: Sequence[str], population: bool = True) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(x - mean) / SD per column (population SD by default; SD 0 -> scale 1)."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c)).alias(f"m_{c}"), sd(F.col(c)).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    stats = {}
    out = df
    for c in cols:
        m = float(row[f"m_{c}"])
        s = row[f"s_{c}"]
        s = 1.0 if (s is None or s == 0 or math.isnan(s)) else float(s)
        stats[c] = (m, s)
        out = out.withColumn(f"__z_{c}", (F.col(c).cast("double") - F.lit(m)) / F.lit(s))
    return out, stats


def propensity_score(df: DataFrame, features: Sequence[str], treat: str = "treatment_group", c: float = 1.0, max_iter: int = 1000, tol: float = 1e-10, out: str = "propensity_score") -> DataFrame:
    """P(treat = 1 | features) from an L2 logistic model on standardised features.

    The objective ``C * sum(logloss) + ||w||^2 / 2`` (intercept free) is Spark's
    ``mean(logloss) + regParam * ||w||^2 / 2`` with ``regParam = 1 / (C n)``.
    Adds ``out`` and ``logit_ps``.
    """
    features = list(features)
    n = df.count()
    scaled, _ = standardize(df, features, population=True)
    zcols = [f"__z_{c_}" for c_ in features]
    assembled = VectorAssembler(inputCols=zcols, outputCol="__features").transform(scaled).withColumn("__label", F.col(treat).cast("double"))
    lr = LogisticRegression(
        featuresCol="__features",
        labelCol="__label",
        maxIter=max_iter,
        tol=tol,
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        probabilityCol="__prob",
        rawPredictionCol="__raw",
        predictionCol="__pred",
    )
    model = lr.fit(assembled)
    _check_gradient(model, assembled, zcols, 1.0 / (c * n))
    scored = model.transform(assembled).withColumn(out, vector_to_array(F.col("__prob"))[1])
    return scored.withColumn("logit_ps", logit(F.col(out))).drop("__features", "__label", "__prob", "__raw", "__pred", *zcols)


def _check_gradient(model, assembled: DataFrame, zcols: Sequence[str], ridge: float, limit: float = 1e-5) -> None:
    """Raise if the penalised objective is not at its minimum (one aggregation)."""
    gap = vector_to_array(F.col("__prob"))[1] - F.col("__label")
    row = model.transform(assembled).agg(F.avg(gap).alias("g"), *[F.avg(gap * F.col(z)).alias(f"g{i}") for i, z in enumerate(zcols)]).first()
    slopes = [row["g"]] + [row[f"g{i}"] + ridge * w for i, w in enumerate(model.coefficients)]
    worst = max(abs(s) for s in slopes)
    if not worst < limit:
        raise RuntimeError(f"propensity model did not converge: largest slope {worst:.3g}")


# --------------------------------------------------------------------------- M5 kernel
def greedy_match(t_ids: np.ndarray, t_scores: np.ndarray, c_ids: np.ndarray, c_scores: np.ndarray, caliper: float) -> list[tuple[int, int, float]]:
    """Sequential greedy 1:1 matching (reference semantics, deterministic ties).

    Treated in ascending (score, id); nearest free control by absolute score
    distance; equal distance -> lowest control id; a match needs distance <=
    caliper. Returns ``[(treated_id, control_id, distance)]`` in match order.
    """
    line = lambda ids, scores: [(float(scores[k]), int(ids[k])) for k in np.lexsort((ids, scores))]
    return walk(line(t_ids, t_scores), line(c_ids, c_scores), 0, [], [], caliper)[0]


# --------------------------------------------------------------------------- M5 on Spark
def match_nearest(df: DataFrame, id_col: str, treat: str, score: str, caliper: float, rows_per_chunk: int = 100_000, exact_on: Sequence[str] | str = ()) -> DataFrame:
    """Exact greedy 1:1 nearest-neighbour matching on ``score`` (e.g. logit PS).

    Returns pairs ``(match_id, treated_id, control_id, distance)``;
    ``match_id`` follows the greedy order (ascending treated score, stratum by
    stratum). Ids may be of any ordered type. With ``exact_on`` only units with
    equal values there are matched (NULL equals NULL). Units without an id, a
    score or a treatment of 0 or 1 are left out. ``rows_per_chunk`` is the size
    of the smallest chunks; a larger table has wider ones (``chunk_rows``). No
    task holds more than about five times a chunk's units, whatever the scores.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    keys = [exact_on] if isinstance(exact_on, str) else list(exact_on)
    x = F.col(score).cast("double")
    t = F.col(treat).cast("int")
    units = df.select(strata(keys).alias("stratum"), F.col(id_col).alias("uid"), (F.lit(1) - t).alias("kind"), (x + F.lit(0.0)).alias("x"))
    units = units.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("kind").isin(0, 1) & F.col("uid").isNotNull())
    return match_line(units, caliper, rows_per_chunk)


def matched_cohort(df: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Rows of both members of each pair, with ``match_id`` (M7)."""
    long = pairs.select(F.col("treated_id").alias(id_col), "match_id").unionByName(pairs.select(F.col("control_id").alias(id_col), "match_id"))
    return df.join(long, on=id_col, how="inner")
