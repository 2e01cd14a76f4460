"""Run the whole study and write its outputs (the files the reference's
notebooks produce): analysis mart, matched cohort, balance table, KM table,
hazard ratios, PH test, SHAP values, SHAP importance and the result summary.

    python tools/run_study.py --tables /root/testdata/sf0.01 --out <shared dir>
    python tools/run_study.py --raw /data/raw --out <shared dir>     # reference schema

``--tables`` runs the study on the given test tables (plans.study role
map); ``--raw`` loads the reference's raw files (``<raw>/hosp/*.csv.gz``,
``<raw>/icu/*.csv.gz``) and runs plans.sepsis. ``--out`` must be a shared
folder on a cluster.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from cohortkit.operators import cox, survival  # noqa: E402
from cohortkit.plans import analysis, sepsis, study  # noqa: E402
from cohortkit.session import ensure_checkpoint_dir, local_session  # noqa: E402
from cohortkit.sources import io  # noqa: E402

RAW_MANIFEST = {"hosp": ["patients", "admissions", "diagnoses_icd", "labevents"], "icu": ["icustays", "inputevents", "d_items"]}


def build_mart(spark: SparkSession, args) -> tuple:
    if args.tables:
        return study.mart(spark, args.tables), analysis.TEST_SPEC
    io.load_all(spark, args.raw, RAW_MANIFEST)

    def t(db: str, name: str):
        return spark.table(f"{db}.{name}")

    mart = sepsis.analysis_cohort(t("hosp", "patients"), t("hosp", "admissions"), t("hosp", "diagnoses_icd"), t("icu", "icustays"), t("icu", "inputevents"), t("icu", "d_items"), t("hosp", "labevents"))
    spec = analysis.StudySpec(sepsis.CONTINUOUS_COVARIATES, sepsis.CATEGORICAL_COVARIATES, sepsis.COX_COVARIATES, sepsis.COX_COVARIATES, ("treatment_group", "lactate"))
    return mart, spec


def main() -> None:
    ap = argparse.ArgumentParser()
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with the given test tables")
    src.add_argument("--raw", help="folder with the reference's raw CSV files")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--no-gbt", action="store_true", help="skip the gradient-boosted model and SHAP")
    args = ap.parse_args()

    spark = SparkSession.getActiveSession() or local_session()
    ensure_checkpoint_dir(spark)
    out = args.out.rstrip("/")
    mart, spec = build_mart(spark, args)
    io.write_stage(mart, f"{out}/analysis_mart")
    res = analysis.run(mart, spec, with_gbt=not args.no_gbt)
    io.write_stage(res["matched"], f"{out}/matched_cohort")
    io.write_stage(res["balance"], f"{out}/balance_table")
    io.write_stage(survival.kaplan_meier(res["matched"], spec.duration, spec.event, spec.label), f"{out}/kaplan_meier")
    io.write_json(cox.cox_summary(spark, res["cox"][0]), f"{out}/hazard_ratios")
    io.write_json(spark.createDataFrame(res["ph_test"], cox.PH_SCHEMA), f"{out}/ph_test")
    io.write_json(res["summary"], f"{out}/results_summary")
    if not args.no_gbt:
        io.write_stage(res["shap"], f"{out}/shap_values")
        io.write_json(res["shap_importance"], f"{out}/shap_importance")
    print(f"wrote study outputs to {out}")


if __name__ == "__main__":
    main()
