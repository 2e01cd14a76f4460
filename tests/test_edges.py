"""Edge tables from FIXTURES.md §4 (balance, survival, screening)."""

import math

from pyspark.sql import functions as F

from cohortkit.operators import balance
from cohortkit.operators import cox as C
from cohortkit.operators import survival as S


def test_smd_edges(spark):
    rows = [(1, 5.0, 1.0, None), (0, 5.0, 2.0, 3.0), (0, 5.0, 4.0, None), (0, 5.0, None, 1.0)]
    df = spark.createDataFrame(rows, "t int, const double, x double, sparse double")
    got = {r["covariate"]: r for r in balance.smd_table(df, ["const", "x", "sparse"], "t").collect()}
    assert got["const"]["smd"] is None  # pooled SD 0
    assert got["x"]["smd"] is None and got["x"]["treated_n"] == 1  # one-row arm: no sample variance
    assert (got["sparse"]["treated_n"], got["sparse"]["control_n"]) == (0, 2) and got["sparse"]["treated_mean"] is None


def test_all_censored(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 0, 1), (3, 0, 0)], "t int, e int, g int")
    km = S.kaplan_meier(df, "t", "e").collect()
    assert all(r["survival"] == 1.0 and r["ci_lower"] == 1.0 for r in km)
    lr = S.logrank_stats(df, "t", "e", "g").first()
    assert lr["variance"] == 0.0 and lr["chi2"] is None
    c = S.concordance(df.withColumn("r", F.col("t") * 1.0), "t", "e", "r").first()
    assert c["n_comparable"] == 0 and c["c_index"] is None


def test_all_events_one_day_and_last_dies(spark):
    df = spark.createDataFrame([(2, 1), (2, 1), (2, 1)], "t int, e int")
    (r,) = S.kaplan_meier(df, "t", "e").collect()
    assert r["survival"] == 0.0 and r["n_at_risk"] == 3 and r["events"] == 3


def test_screening_null_outcome(spark):
    rows = [(float(i % 5) if i != 7 else None, 1 if i % 3 else 0, float(i), float((i * 7) % 11)) for i in range(30)]
    df = spark.createDataFrame(rows, "t double, e int, a double, b double")
    out, kept, dropped = C.screen_covariates(df, ["a", "b"], "t", "e")
    assert kept == ["a", "b"] and dropped == []
    assert out.count() == 29  # the row with a NULL duration is dropped
    assert not math.isnan(C.cox_ph(out, "t", "e", kept).coef[0])


def test_one_arm_support_and_caliper(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "t int, ps double")
    out, (lo, hi) = balance.trim_common_support(df, "ps", "t")
    assert out.count() == 0 and lo != lo
    one = spark.createDataFrame([(1, 0.3)], "t int, ps double")
    assert math.isnan(balance.caliper(one, "ps"))
