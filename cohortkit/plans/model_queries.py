"""Model-based queries (propensity, matching, Cox, GBT/SHAP).

No SQL oracle can fit these models, so they are registered without one;
pytest checks each operator against a NumPy / brute-force oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import balance, cox, interpret, survival
from . import analysis, study
from .oracle_sql import with_mart
from .registry import register

CONT = study.CONTINUOUS


@register("propensity_score", "stay_id:i, treatment_group:i, propensity_score:d, logit_ps:d")
def q_ps(spark, sf):
    return analysis.scored(spark, sf)


@register("match_nearest", "match_id:i, treated_id:i, control_id:i, distance:d")
def q_match(spark, sf):
    return analysis.matched(spark, sf)[0]


@register("matched_cohort", "stay_id:i, match_id:i, treatment_group:i, propensity_score:d, logit_ps:d, time_to_event_days:i, event_observed:i")
def q_matched(spark, sf):
    return analysis.matched(spark, sf)[1]


@register(
    "balance_table",
    "covariate:s, mean_treated_before:d, mean_control_before:d, smd_before:d, mean_treated_after:d, mean_control_after:d, smd_after:d, balanced_after:b",
)
def q_balance(spark, sf):
    enc, _, _ = analysis.encoded(spark, sf)
    return balance.balance_table(enc, analysis.matched(spark, sf)[1], CONT)


@register("kaplan_meier_matched", "treatment_label:s, time:i, n_at_risk:i, events:i, censored:i, survival:d, ci_lower:d, ci_upper:d")
def q_km_matched(spark, sf):
    return survival.kaplan_meier(analysis.matched(spark, sf)[1], "time_to_event_days", "event_observed", "treatment_label")


@register("logrank_test", "observed_1:d, expected_1:d, variance:d, chi2:d, p_value:d")
def q_logrank_p(spark, sf):
    return survival.logrank(analysis.matched(spark, sf)[1], "time_to_event_days", "event_observed", "treatment_group", 1)


@register("screen_covariates", "covariate:s, reason:s")
def q_screen(spark, sf):
    _, _, kept, dropped = analysis.cox_model(spark, sf)
    rows = [(c, "kept") for c in kept] + list(dropped)
    return spark.createDataFrame(rows, "covariate string, reason string")


@register("cox_ph", "covariate:s, coef:d, hr:d, se:d, ci_lower:d, ci_upper:d, z:d, p_value:d")
def q_cox(spark, sf):
    return cox.cox_summary(spark, analysis.cox_model(spark, sf)[0])


@register("cox_crude", "covariate:s, coef:d, hr:d, se:d, ci_lower:d, ci_upper:d, z:d, p_value:d")
def q_cox_crude(spark, sf):
    return cox.cox_summary(spark, analysis.crude_model(spark, sf))


@register("ph_test", "covariate:s, test_statistic:d, p_value:d")
def q_ph(spark, sf):
    return spark.createDataFrame(cox.ph_test(analysis.cox_model(spark, sf)[0]), cox.PH_SCHEMA)


@register("cox_concordance", "c_index:d, n_comparable:i, n_concordant:i, n_tied_risk:i")
def q_cox_c(spark, sf):
    model, clean, _, _ = analysis.cox_model(spark, sf)
    return survival.concordance(clean.withColumn("risk", cox.predict_risk(model)), "time_to_event_days", "event_observed", "risk")


@register("results_summary", "n_matched_total:i, n_exposed:i, n_comparator:i, event_rate_exposed:d, event_rate_comparator:d, logrank_p:d, hr_treatment:d, hr_ci_lower:d, hr_ci_upper:d, hr_p_value:d, c_index:d, hr_crude:d, hr_shift:d")
def q_summary(spark, sf):
    return analysis.results_summary(spark, sf)


@register("stratified_folds", "event_observed:i, fold:i, n:i")
def q_folds(spark, sf):
    _, mc, _, _ = analysis.matched(spark, sf)
    f = interpret.stratified_folds(interpret.complete_rows(mc, analysis.SHAP_FEATURES + ["event_observed"]), "event_observed", "stay_id", 5, 42)
    return f.groupBy("event_observed", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("gbt_cv_auc", "fold:i, auc:d")
def q_cv(spark, sf):
    _, mc, _, _ = analysis.matched(spark, sf)
    return interpret.stratified_cv_auc(mc, analysis.SHAP_FEATURES, "event_observed", "stay_id", 5, **analysis.TEST_SPEC.gbt)


@register("gbt_train_auc", "auc:d, n_pairs:i")
def q_train_auc(spark, sf):
    shap_df, _ = analysis.shap_values(spark, sf)
    return survival.roc_auc(shap_df, "predicted_proba", "event_observed")


SHAP_SPEC = "stay_id:i, " + ", ".join(f"shap_{f}:d" for f in analysis.SHAP_FEATURES) + ", predicted_proba:d, event_observed:i, shap_interaction:d"


@register("tree_shap", SHAP_SPEC)
def q_shap(spark, sf):
    return analysis.shap_values(spark, sf)[0]


@register("shap_importance", "feature:s, mean_abs_shap:d")
def q_shap_imp(spark, sf):
    return interpret.shap_importance(analysis.shap_values(spark, sf)[0], analysis.SHAP_FEATURES)


@register("shap_top_features", "feature:s, mean_abs_shap:d")
def q_shap_top(spark, sf):
    imp = interpret.shap_importance(analysis.shap_values(spark, sf)[0], analysis.SHAP_FEATURES)
    return imp.orderBy(F.col("mean_abs_shap").desc(), "feature").limit(4)


@register("shap_treatment_signs", "n:i, mean:d, n_pos:i, n_neg:i, share_pos:d, share_neg:d")
def q_shap_sign(spark, sf):
    from ..operators.describe import sign_summary

    return sign_summary(analysis.shap_values(spark, sf)[0], "shap_treatment_group")


@register("shap_interaction_summary", "n:i, mean_abs_interaction:d")
def q_shap_inter(spark, sf):
    shap_df, _ = analysis.shap_values(spark, sf)
    return shap_df.agg(F.count("shap_interaction").alias("n"), F.avg(F.abs("shap_interaction")).alias("mean_abs_interaction"))


@register("explain_rows", "which:s, stay_id:i, score:d, feature:s, value:d, shap:d, rank:i")
def q_explain(spark, sf):
    return interpret.explain_rows(analysis.shap_values(spark, sf)[0], analysis.SHAP_FEATURES, "stay_id")


# ============================================================== sources (IO1-IO11)
def _raw_copy(spark, sf, table: str) -> str:
    """Write a given table as gzipped CSV below the checkpoint folder (the
    raw-file form the loader reads); returns its folder."""
    from ..session import scratch_path

    path = scratch_path(spark, f"raw-{table}")
    study.load(spark, sf, table).write.option("header", True).option("compression", "gzip").csv(path)
    return path


@register(
    "raw_load_roundtrip",
    "table:s, expected:i, actual:i, ok:b, n_columns:i",
    """
    SELECT 'customer' AS "table", count(*) AS expected, count(*) AS actual, true AS ok, 5 AS n_columns FROM customer
    UNION ALL
    SELECT 'orders', count(*), count(*), true, 6 FROM orders
    """,
)
def q_raw_load(spark, sf):
    from ..operators.quality import reconcile_counts
    from ..session import scratch_path
    from ..sources import io

    db_root = scratch_path(spark, "warehouse")
    io.ensure_databases(spark, ["hosp_raw"], location=db_root)
    pairs = []
    widths = {}
    for t in ("customer", "orders"):
        raw = io.read_raw(spark, _raw_copy(spark, sf, t))
        name = io.load_table(raw, "hosp_raw", t)
        tbl = spark.table(name)
        widths[t] = len(tbl.columns)
        pairs.append((t, raw, tbl))
    out = reconcile_counts(pairs)
    return out.withColumn("n_columns", F.when(F.col("table") == "customer", F.lit(widths["customer"])).otherwise(F.lit(widths["orders"])))


@register(
    "stage_roundtrip",
    "n_rows:i, n_events:i, sum_duration:i",
    with_mart("SELECT count(*) AS n_rows, sum(event_observed) AS n_events, sum(time_to_event_days) AS sum_duration FROM mart"),
)
def q_stage_roundtrip(spark, sf):
    from ..session import scratch_path
    from ..sources import io

    path = io.write_stage(study.shared_mart(spark, sf), scratch_path(spark, "stage-mart"))
    back = io.read_stage(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_observed").alias("n_events"), F.sum("time_to_event_days").alias("sum_duration"))


@register("shap_long", "stay_id:i, feature:s, value:d, shap:d")
def q_shap_long(spark, sf):
    return interpret.shap_long(analysis.shap_values(spark, sf)[0], analysis.SHAP_FEATURES, "stay_id")


@register("shap_treatment_histogram", "bin:i, lo:d, hi:d, n:i, density:d")
def q_shap_hist(spark, sf):
    from ..operators.describe import histogram

    return histogram(analysis.shap_values(spark, sf)[0], "shap_treatment_group", None, 40)


@register("result_files", "artifact:s, format:s, n_rows:i")
def q_result_files(spark, sf):
    """G10 / IO9 / IO10: SHAP table as parquet, importance and the result
    summary as JSON, read back."""
    from ..session import scratch_path
    from ..sources import io

    shap_df, _ = analysis.shap_values(spark, sf)
    out = []
    p1 = io.write_stage(shap_df, scratch_path(spark, "shap-values"))
    out.append(("shap_values", "parquet", io.read_stage(spark, p1).count()))
    p2 = io.write_json(interpret.shap_importance(shap_df, analysis.SHAP_FEATURES), scratch_path(spark, "shap-importance"))
    out.append(("shap_importance", "json", spark.read.json(p2).count()))
    p3 = io.write_json(analysis.results_summary(spark, sf), scratch_path(spark, "results-summary"))
    out.append(("results_summary", "json", spark.read.json(p3).count()))
    return spark.createDataFrame(out, "artifact string, format string, n_rows long")


# ============================================================== per-stage reports of the study
@register("propensity_describe", "treatment_label:s, column:s, count:i, mean:d, std:d, min:d, q25:d, median:d, q75:d, max:d")
def q_ps_describe(spark, sf):
    from ..operators.describe import describe

    return describe(analysis.scored(spark, sf), ["propensity_score"], by="treatment_label")


@register("propensity_histogram", "treatment_label:s, bin:i, lo:d, hi:d, n:i, density:d")
def q_ps_hist(spark, sf):
    from ..operators.describe import histogram

    return histogram(analysis.scored(spark, sf), "propensity_score", "treatment_label", 50)


@register("matched_counts", "treatment_label:s, n:i")
def q_matched_counts(spark, sf):
    from ..operators.describe import value_counts

    return value_counts(analysis.matched(spark, sf)[1], "treatment_label")


@register("matched_ps_histogram", "treatment_label:s, bin:i, lo:d, hi:d, n:i, density:d")
def q_matched_ps_hist(spark, sf):
    from ..operators.describe import histogram

    return histogram(analysis.matched(spark, sf)[1], "propensity_score", "treatment_label", 40)


@register("matched_event_rates", "treatment_label:s, n_events:d, n:i, rate:d")
def q_matched_rates(spark, sf):
    from ..operators.describe import rate_by_group

    return rate_by_group(analysis.matched(spark, sf)[1], "treatment_label", "event_observed")


@register("survival_at_matched", "treatment_label:s, time_point:d, survival:d")
def q_surv_at_matched(spark, sf):
    km = survival.kaplan_meier(analysis.matched(spark, sf)[1], "time_to_event_days", "event_observed", "treatment_label")
    return survival.survival_at(km, [7.0, 14.0, 21.0, 28.0], "treatment_label")


@register("cox_diagnostics", "column:s, n_missing:i, n_zero:i")
def q_cox_diag(spark, sf):
    from ..operators.quality import missingness, zero_counts

    mc = analysis.matched(spark, sf)[1]
    cols = analysis.TEST_SPEC.cox_covariates
    return missingness(mc, cols).select("column", "n_missing").join(zero_counts(mc, cols), "column")


@register(
    "load_all_manifest",
    "run:i, db:s, table:s, action:s, expected:i, actual:i",
    "\nUNION ALL\n".join(
        f"SELECT {run} AS run, 'raw_hosp' AS db, '{t}' AS \"table\", '{action}' AS action, count(*) AS expected, count(*) AS actual FROM {t}"
        for run, actions in enumerate([("loaded", "loaded"), ("skipped", "skipped"), ("reloaded", "skipped")], 1)
        for t, action in zip(("orders", "lineitem"), actions, strict=True)
    )
    + "".join(f"\nUNION ALL SELECT {run}, 'raw_hosp', 'absent', 'missing_source', NULL, NULL" for run in (1, 2, 3)),
)
def q_load_all(spark, sf):
    """IO6: idempotent manifest load of raw gzipped CSV copies of two given
    tables: the first run loads, the second finds equal content and skips, the
    third finds one source changed in content though not in count."""
    from ..session import scratch_path
    from ..sources import io

    base = scratch_path(spark, "raw-base")
    db = f"raw_hosp_{uuid.uuid4().hex[:10]}"  # of this run; dropped at the end

    def put(t, df):
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{base}/{db}/{t}.csv.gz")

    for t in ("orders", "lineitem"):
        put(t, study.load(spark, sf, t))
    manifest = {db: ["orders", "lineitem", "absent"]}
    rows = []
    io.ensure_databases(spark, [db], location=scratch_path(spark, "warehouse"))
    try:
        for run in (1, 2, 3):
            if run == 3:
                put("orders", study.load(spark, sf, "orders").withColumn("o_custkey", F.col("o_custkey") + 1))
            for r in io.load_all(spark, base, manifest):
                rows.append((run, "raw_hosp", r.table, r.action, r.expected, r.actual))
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.createDataFrame(rows, "run int, db string, table string, action string, expected long, actual long")
