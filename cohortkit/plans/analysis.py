"""The analysis stages of the study on an analysis mart: imputation and
encoding, propensity scores, trimming, caliper matching, survival, Cox,
gradient-boosted model and SHAP.

``StudySpec`` names the columns; every stage takes the mart (or the previous
stage's output) and a spec, so the same code runs on the reference-schema
mart (``plans.sepsis``) and on the test-table mart (``plans.study``). The
``*_for`` helpers memoise the stage results of the test-table study per
(session, data folder) because several registered reports read them; each
memoised stage is checkpointed into the reliable checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance, cox, interpret, matching, survival
from . import study

GBT = {"max_iter": 200, "step_size": 0.05, "max_depth": 4, "subsample": 0.8, "seed": 42}


@dataclass
class StudySpec:
    continuous: list[str]
    categorical: list[str]
    cox_covariates: list[str]
    shap_features: list[str]
    interaction: tuple[str, str] | None = None
    unit_id: str = "stay_id"
    treat: str = "treatment_group"
    label: str = "treatment_label"
    duration: str = "time_to_event_days"
    event: str = "event_observed"
    caliper_sd: float = 0.2
    penalizer: float = 0.1
    gbt: dict = field(default_factory=lambda: dict(GBT))


TEST_SPEC = StudySpec(study.CONTINUOUS, study.CATEGORICAL, study.COX_COVARIATES, study.COX_COVARIATES, ("treatment_group", "v_error"))
SHAP_FEATURES = TEST_SPEC.shap_features


# --------------------------------------------------------------------------- stages
def encode(mart: DataFrame, spec: StudySpec) -> tuple[DataFrame, list[str], dict]:
    """Median-imputed continuous covariates + first-level-dropped dummies."""
    imp, med = balance.impute_median(mart, spec.continuous)
    enc, dummies = balance.one_hot(imp, spec.categorical)
    return enc, dummies, med


def score(enc: DataFrame, dummies: list[str], spec: StudySpec) -> DataFrame:
    return matching.propensity_score(enc, spec.continuous + dummies, spec.treat)


def match(ps: DataFrame, spec: StudySpec) -> tuple[DataFrame, DataFrame, float, tuple[float, float]]:
    """Trim to common support, caliper on logit PS, exact greedy matching.
    Returns (pairs, matched cohort, caliper, support bounds)."""
    trimmed, bounds = balance.trim_common_support(ps, "propensity_score", spec.treat)
    cal = balance.caliper(trimmed, "propensity_score", spec.caliper_sd)
    pairs = matching.match_nearest(trimmed, spec.unit_id, spec.treat, "logit_ps", cal)
    return pairs, matching.matched_cohort(trimmed, pairs, spec.unit_id), cal, bounds


def fit_cox(matched: DataFrame, spec: StudySpec):
    """Screened covariates + penalised Cox: (model, clean frame, kept, dropped)."""
    clean, kept, dropped = cox.screen_covariates(matched, spec.cox_covariates, spec.duration, spec.event)
    model = cox.cox_ph(clean, spec.duration, spec.event, kept, penalizer=spec.penalizer)
    return model, clean, kept, dropped


def fit_crude(mart: DataFrame, spec: StudySpec):
    raw = mart.na.drop(subset=[spec.duration, spec.event, spec.treat])
    return cox.cox_ph(raw, spec.duration, spec.event, [spec.treat], penalizer=0.0)


def fit_gbt(matched: DataFrame, spec: StudySpec):
    return interpret.fit_gbt(matched, spec.shap_features, spec.event, **spec.gbt)


def shap(model, matched: DataFrame, spec: StudySpec) -> tuple[DataFrame, float]:
    keep = [spec.unit_id, spec.event, spec.label]
    return interpret.tree_shap(model, matched, spec.shap_features, keep=keep, interaction=spec.interaction)


def summary(matched: DataFrame, cox_fit, crude_model, spec: StudySpec) -> DataFrame:
    """One-row result summary (C8)."""
    model, clean, kept, _ = cox_fit
    lr = survival.logrank(matched, spec.duration, spec.event, spec.treat, 1).select("p_value").first()["p_value"]
    c_index = survival.concordance(clean.withColumn("__risk", cox.predict_risk(model)), spec.duration, spec.event, "__risk").first()["c_index"]
    arms = matched.groupBy().agg(
        F.count(F.lit(1)).alias("n_matched_total"),
        F.count_if(F.col(spec.treat) == 1).alias("n_exposed"),
        F.count_if(F.col(spec.treat) == 0).alias("n_comparator"),
        F.avg(F.when(F.col(spec.treat) == 1, F.col(spec.event))).alias("event_rate_exposed"),
        F.avg(F.when(F.col(spec.treat) == 0, F.col(spec.event))).alias("event_rate_comparator"),
    )
    row = model.summary_rows()[kept.index(spec.treat)] if spec.treat in kept else None
    hr = None if row is None else row[2]
    crude_hr = float(crude_model.hazard_ratios[0])
    extra = {
        "logrank_p": float(lr),
        "hr_treatment": hr,
        "hr_ci_lower": None if row is None else row[4],
        "hr_ci_upper": None if row is None else row[5],
        "hr_p_value": None if row is None else row[7],
        "c_index": float(c_index),
        "hr_crude": crude_hr,
        "hr_shift": None if hr is None else abs(crude_hr - hr) / crude_hr,
    }
    out = arms
    for k, v in extra.items():
        out = out.withColumn(k, F.lit(v).cast("double"))
    return out


def run(mart: DataFrame, spec: StudySpec, with_gbt: bool = True) -> dict[str, object]:
    """Every stage on one mart; returns the named results."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(mart.sparkSession)
    enc, dummies, med = encode(mart, spec)
    enc = enc.checkpoint(eager=True)
    ps = score(enc, dummies, spec).checkpoint(eager=True)
    pairs, matched, cal, bounds = match(ps, spec)
    matched = matched.checkpoint(eager=True)
    cox_fit = fit_cox(matched, spec)
    crude = fit_crude(mart, spec)
    out = {
        "medians": med,
        "dummies": dummies,
        "propensity": ps,
        "support": bounds,
        "caliper": cal,
        "pairs": pairs,
        "matched": matched,
        "balance": balance.balance_table(enc, matched, spec.continuous),
        "kaplan_meier": survival.kaplan_meier(matched, spec.duration, spec.event, spec.label),
        "logrank": survival.logrank(matched, spec.duration, spec.event, spec.treat, 1),
        "cox": cox_fit,
        "crude": crude,
        "ph_test": cox.ph_test(cox_fit[0]),
        "summary": summary(matched, cox_fit, crude, spec),
    }
    if with_gbt:
        model = fit_gbt(matched, spec)
        shap_df, base = shap(model, matched, spec)
        out.update({"gbt": model, "shap": shap_df, "shap_base": base, "shap_importance": interpret.shap_importance(shap_df, spec.shap_features)})
    return out


# --------------------------------------------------------------------------- memoised test-table study
_MEMO: dict[tuple[str, str], object] = {}


def _memo(spark: SparkSession, sf_dir: str, name: str, fn):
    key = (study.data_key(spark, sf_dir), name)
    if key not in _MEMO:
        _MEMO[key] = fn()
    return _MEMO[key]


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], dict]:
    def build():
        enc, dummies, med = encode(study.shared_mart(spark, sf_dir), TEST_SPEC)
        return enc.checkpoint(eager=True), dummies, med

    return _memo(spark, sf_dir, "encoded", build)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        enc, dummies, _ = encoded(spark, sf_dir)
        return score(enc, dummies, TEST_SPEC).checkpoint(eager=True)

    return _memo(spark, sf_dir, "scored", build)


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, float, tuple[float, float]]:
    def build():
        pairs, mc, cal, bounds = match(scored(spark, sf_dir), TEST_SPEC)
        return pairs, mc.checkpoint(eager=True), cal, bounds

    return _memo(spark, sf_dir, "matched", build)


def cox_model(spark: SparkSession, sf_dir: str):
    def build():
        model, clean, kept, dropped = fit_cox(matched(spark, sf_dir)[1], TEST_SPEC)
        return model, clean.checkpoint(eager=True), kept, dropped

    return _memo(spark, sf_dir, "cox", build)


def crude_model(spark: SparkSession, sf_dir: str):
    return _memo(spark, sf_dir, "crude", lambda: fit_crude(study.shared_mart(spark, sf_dir), TEST_SPEC))


def gbt_model(spark: SparkSession, sf_dir: str):
    return _memo(spark, sf_dir, "gbt", lambda: fit_gbt(matched(spark, sf_dir)[1], TEST_SPEC))


def shap_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    def build():
        df, base = shap(gbt_model(spark, sf_dir), matched(spark, sf_dir)[1], TEST_SPEC)
        return df.checkpoint(eager=True), base

    return _memo(spark, sf_dir, "shap", build)


def results_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(matched(spark, sf_dir)[1], cox_model(spark, sf_dir), crude_model(spark, sf_dir), TEST_SPEC)
