"""The reference-schema study on a hand-made edge fixture (all raw strings)."""

import pytest

from cohortkit.plans import sepsis


def _df(spark, cols, rows):
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{c} string" for c in cols))


@pytest.fixture(scope="module")
def raw(spark):
    patients = _df(
        spark,
        ["SUBJECT_ID", "GENDER", "ANCHOR_AGE", "ANCHOR_YEAR", "ANCHOR_YEAR_GROUP", "DOD"],
        [
            (1, "F", 60, 2150, "2017 - 2019", None),
            (2, "M", 17, 2150, "2017 - 2019", None),  # 17 at admission -> out
            (3, "M", 88, 2148, "2017 - 2019", None),  # 90 at admission -> out
            (4, "F", 50, 2150, "2017 - 2019", "2150-02-03"),
            (5, "M", 70, 2150, "2017 - 2019", None),
        ],
    )
    adm_cols = ["SUBJECT_ID", "HADM_ID", "ADMITTIME", "DISCHTIME", "DEATHTIME", "ADMISSION_TYPE", "ADMISSION_LOCATION", "DISCHARGE_LOCATION", "INSURANCE", "MARITAL_STATUS", "RACE", "HOSPITAL_EXPIRE_FLAG"]
    admissions = _df(
        spark,
        adm_cols,
        [
            (1, 11, "2150-01-01 00:59:00", "2150-01-10 10:00:00", None, "EW", "ER", "HOME", "Medicare", "MARRIED", "WHITE", 0),
            (2, 21, "2150-01-01 00:00:00", "2150-01-05 00:00:00", None, "EW", "ER", "HOME", "Other", "SINGLE", "BLACK", 0),
            (3, 31, "2150-01-01 00:00:00", "2150-01-05 00:00:00", None, "EW", "ER", "HOME", "Other", "SINGLE", "ASIAN", 0),
            (4, 41, "2150-01-05 08:00:00", "2150-01-20 00:00:00", "2150-02-03 09:00:00", "EW", "ER", "DIED", "Medicaid", "WIDOWED", "WHITE", 1),
            (5, 51, "2150-03-01 00:00:00", "2150-03-04 00:00:00", None, "EW", "ER", "HOME", "Other", "SINGLE", "WHITE", 0),
            (1, 61, "2150-05-01 08:00:00", "2150-05-04 00:00:00", None, "EW", "ER", "HOME", "Medicare", "MARRIED", "WHITE", 0),
            (5, 71, "2150-06-01 08:00:00", "2150-06-03 00:00:00", None, "EW", "ER", "HOME", "Other", "SINGLE", "WHITE", 0),
        ],
    )
    diagnoses = _df(
        spark,
        ["SUBJECT_ID", "HADM_ID", "SEQ_NUM", "ICD_CODE", "ICD_VERSION"],
        [(1, 11, 1, "A41.9", 10), (2, 21, 1, "A419", 10), (3, 31, 1, "A419", 10), (4, 41, 2, "99591", 9), (5, 51, 1, "A419", 9), (1, 61, 1, "R6521", 10), (5, 71, 1, "A4150", 10), (1, 11, 2, "I10", 10)],
    )
    icustays = _df(
        spark,
        ["SUBJECT_ID", "HADM_ID", "STAY_ID", "FIRST_CAREUNIT", "LAST_CAREUNIT", "INTIME", "OUTTIME"],
        [
            (1, 11, 101, "MICU", "MICU", "2150-01-01 05:00:00", "2150-01-03 05:00:00"),
            (2, 21, 201, "MICU", "MICU", "2150-01-01 05:00:00", "2150-01-03 05:00:00"),
            (3, 31, 301, "MICU", "MICU", "2150-01-01 05:00:00", "2150-01-03 05:00:00"),
            (4, 41, 401, "MICU", "MICU", "2150-01-05 10:00:00", "2150-01-07 10:00:00"),
            (5, 51, 501, "MICU", "MICU", "2150-03-01 05:00:00", "2150-03-02 05:00:00"),
            (1, 61, 601, "SICU", "SICU", "2150-05-01 10:00:00", "2150-05-01 14:00:00"),  # exactly 4 h -> in
            (1, 61, 602, "SICU", "SICU", "2150-05-02 10:00:00", "2150-05-03 10:00:00"),  # second stay -> out
            (5, 71, 701, "SICU", "SICU", "2150-06-01 10:00:00", "2150-06-01 13:59:00"),  # < 4 h -> out
        ],
    )
    inputevents = _df(
        spark,
        ["SUBJECT_ID", "HADM_ID", "STAY_ID", "ITEMID", "STARTTIME", "AMOUNT", "AMOUNTUOM"],
        [
            (1, 11, 101, 221906, "2150-01-01 06:00:00", 1.0, "mg"),
            (1, 11, 101, 225158, "2150-01-01 07:00:00", 500.0, "ml"),
            (1, 11, 101, 225158, "2150-01-01 08:00:00", 1.0, "L"),  # not ml: not summed
            (1, 11, 101, 221289, "2150-01-02 05:00:00", 1.0, "mg"),  # index + 24 h: out
            (4, 41, 401, 225828, "2150-01-05 12:00:00", 1000.0, "ml"),
            (4, 41, 401, 999, "2150-01-05 12:30:00", 5.0, "ml"),
        ],
    )
    d_items = _df(spark, ["ITEMID", "LABEL"], [(221906, "Norepinephrine"), (221289, "Epinephrine"), (225158, "NaCl 0.9%"), (225828, "LR"), (999, "Other")])
    labevents = _df(
        spark,
        ["LABEVENT_ID", "HADM_ID", "ITEMID", "CHARTTIME", "VALUENUM"],
        [
            (1, 11, 51006, "2150-01-01 05:30:00", None),
            (2, 11, 51006, "2150-01-01 06:00:00", 0),
            (3, 11, 51006, "2150-01-01 07:00:00", 20),
            (11, 11, 50912, "2150-01-01 06:00:00", 1.5),
            (10, 11, 50912, "2150-01-01 06:00:00", 1.2),
            (12, 11, 50813, "2150-01-01 11:00:00", 4.0),  # index + 6 h: out
            (20, 41, 51301, "2150-01-05 11:00:00", 12.5),
        ],
    )
    return patients, admissions, diagnoses, icustays, inputevents, d_items, labevents


def test_cohort(raw):
    p, a, d, i, *_ = raw
    rows = {r["stay_id"]: r for r in sepsis.sepsis_cohort(p, a, d, i).collect()}
    assert sorted(rows) == [101, 401, 601]
    r = rows[101]
    assert (r["age_at_admission"], r["icu_los_days"], r["time_to_event_days"], r["event_observed"]) == (60, 2.0, 9, 0)
    assert abs(r["hospital_los_days"] - 226 / 24) < 1e-12
    r = rows[401]
    assert (r["outcome_mortality_28d"], r["time_to_event_days"], r["event_observed"], r["mortality_28d"]) == (0, 29, 1, 0)
    assert rows[601]["icu_los_days"] == 4 / 24


def test_treatment_and_mart(raw):
    p, a, d, i, ie, items, le = raw
    coh = sepsis.sepsis_cohort(p, a, d, i)
    t = {r["stay_id"]: r for r in sepsis.treatment_flags(coh, ie, items).collect()}
    assert (t[101]["treatment_group"], t[101]["total_fluid_ml"], t[101]["vasopressor_count"], str(t[101]["first_vasopressor_time"])) == (1, 500.0, 1, "2150-01-01 06:00:00")
    assert (t[401]["treatment_group"], t[401]["treatment_label"], t[401]["total_fluid_ml"]) == (0, "fluid_only", 1000.0)
    assert (t[601]["treatment_group"], t[601]["treatment_label"], t[601]["received_fluid"]) == (None, "neither", 0)
    mart = {r["stay_id"]: r for r in sepsis.analysis_cohort(p, a, d, i, ie, items, le).collect()}
    assert sorted(mart) == [101, 401]
    assert (mart[101]["bun"], mart[101]["creatinine"], mart[101]["lactate"]) == (20.0, 1.2, None)
    assert mart[401]["wbc"] == 12.5 and mart[401]["bun"] is None


def test_analysis_runs_from_a_spec(spark, raw):
    """``analysis.run`` drives every stage from a StudySpec on any mart
    (here the mart built from the given test tables)."""
    from cohortkit.plans import analysis, study
    from .conftest import SF01

    m = study.shared_mart(spark, SF01)
    spec = analysis.StudySpec(study.CONTINUOUS, study.CATEGORICAL, study.COX_COVARIATES, study.COX_COVARIATES, ("treatment_group", "v_error"), gbt={"max_iter": 5, "max_depth": 3, "subsample": 0.8, "seed": 1})
    out = analysis.run(m, spec)
    s = out["summary"].first()
    assert s["n_exposed"] == s["n_comparator"] > 0
    assert out["matched"].count() == 2 * out["pairs"].count()
    assert out["shap_importance"].count() == len(spec.shap_features)
