"""The reference study on its own raw schema (all columns arrive as strings).

Staging views type every column once (``try_cast`` / ``try_to_timestamp``),
then the cohort, treatment-flag and mart stages are built from the generic
operators. Inputs are DataFrames (e.g. ``read_raw`` of each file or
``spark.table`` of the loaded tables):

    patients      subject_id, gender, anchor_age, anchor_year, anchor_year_group, dod
    admissions    subject_id, hadm_id, admittime, dischtime, deathtime, admission_type,
                  admission_location, discharge_location, insurance, marital_status,
                  race, hospital_expire_flag
    diagnoses_icd subject_id, hadm_id, seq_num, icd_code, icd_version
    icustays      subject_id, hadm_id, stay_id, first_careunit, last_careunit, intime, outtime
    inputevents   subject_id, hadm_id, stay_id, itemid, starttime, amount, amountuom
    d_items       itemid, label
    labevents     labevent_id, hadm_id, itemid, charttime, valuenum

Column names are matched case-insensitively (raw loads upper-case them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import boundary_diff, categorize, flag, flag_codes, is_present, los_days
from ..operators.cohort import analysis_mart, baseline_covariates, broadcast_if_small, exposure_flags, has_any, sequence_number

# Fixed values of the reference study: diagnosis codes, input items, lab items.
SEPSIS_ICD10 = ["A419", "A41.9", "A410", "A41.0", "A411", "A41.1", "A4150", "A41.50", "A4151", "A41.51", "A4152", "A41.52", "A4153", "A41.53", "A4159", "A41.59", "R6520", "R65.20", "R6521", "R65.21"]
SEPSIS_ICD9 = ["99591", "99592"]
VASOPRESSOR_ITEMS = [221906, 221289, 221662, 222315, 221749]
FLUID_ITEMS = [225158, 225159, 225161, 220949, 225828, 225827, 220864, 220862, 225174, 225975, 225976]
LAB_ITEMS = {"bun": 51006, "creatinine": 50912, "bilirubin": 50885, "platelets": 51265, "wbc": 51301, "lactate": 50813, "bicarbonate": 50882}
AGE_MIN, AGE_MAX = 18, 89
MIN_ICU_LOS_DAYS = 4.0 / 24.0
EXPOSURE_HOURS = 24
LAB_HOURS = 6
HORIZON_DAYS = 28
ARM_LABELS = ("vasopressor", "fluid_only", "neither")


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _ts(c: str):
    return F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz").alias(c)


def _long(c: str):
    return F.col(c).try_cast("long")


def _int(c: str):
    return F.col(c).try_cast("int")


# --------------------------------------------------------------------------- staging (P1)
def stage_patients(raw: DataFrame) -> DataFrame:
    p = _lower(raw)
    return p.select(
        _long("subject_id").alias("subject_id"),
        F.col("gender"),
        _int("anchor_age").alias("age_at_anchor"),
        _int("anchor_year").alias("anchor_year"),
        F.col("anchor_year_group"),
        _ts("dod").alias("date_of_death"),
        is_present(F.col("dod")).alias("died_in_hospital"),
    )


def stage_admissions(raw: DataFrame) -> DataFrame:
    a = _lower(raw).select(
        _long("subject_id").alias("subject_id"),
        _long("hadm_id").alias("hadm_id"),
        _ts("admittime").alias("admit_time"),
        _ts("dischtime").alias("discharge_time"),
        _ts("deathtime").alias("death_time"),
        "admission_type",
        "admission_location",
        "discharge_location",
        "insurance",
        "marital_status",
        "race",
        _int("hospital_expire_flag").alias("died_during_admission"),
    )
    return a.withColumn("los_days", los_days("admit_time", "discharge_time")).withColumn(
        "mortality_28d", flag(F.col("death_time").isNotNull() & (boundary_diff("day", "admit_time", "death_time") <= HORIZON_DAYS))
    )


def stage_diagnoses(raw: DataFrame) -> DataFrame:
    d = _lower(raw).select(_long("subject_id").alias("subject_id"), _long("hadm_id").alias("hadm_id"), _int("seq_num").alias("seq_num"), "icd_code", _int("icd_version").alias("icd_version"))
    return d.withColumn("is_sepsis_dx", flag_codes("icd_code", "icd_version", {10: SEPSIS_ICD10, 9: SEPSIS_ICD9}))


def stage_icustays(raw: DataFrame) -> DataFrame:
    i = _lower(raw).select(
        _long("subject_id").alias("subject_id"),
        _long("hadm_id").alias("hadm_id"),
        _long("stay_id").alias("stay_id"),
        "first_careunit",
        "last_careunit",
        _ts("intime").alias("icu_intime"),
        _ts("outtime").alias("icu_outtime"),
    )
    i = i.withColumn("icu_los_days", los_days("icu_intime", "icu_outtime"))
    return sequence_number(i, "hadm_id", ["icu_intime"], "stay_id", "icu_stay_seq")


# --------------------------------------------------------------------------- K1 / K2
def sepsis_cohort(patients: DataFrame, admissions: DataFrame, diagnoses: DataFrame, icustays: DataFrame) -> DataFrame:
    """First ICU stay per admission, adults 18..89, sepsis code, stay >= 4 h."""
    p = stage_patients(patients)
    a = stage_admissions(admissions)
    dx = stage_diagnoses(diagnoses)
    icu = stage_icustays(icustays).where(F.col("icu_stay_seq") == 1)
    sepsis = dx.where(F.col("is_sepsis_dx") == 1).select("hadm_id")
    pa = p.join(a, "subject_id").withColumn("age_at_admission", F.col("age_at_anchor") + (F.year("admit_time") - F.col("anchor_year")))
    c = has_any(pa.join(icu.drop("subject_id"), "hadm_id"), sepsis, "hadm_id").where(
        (F.col("age_at_admission") >= AGE_MIN)
        & (F.col("age_at_admission") <= AGE_MAX)
        & (F.col("icu_los_days") >= MIN_ICU_LOS_DAYS)
        & F.col("admit_time").isNotNull()
        & F.col("discharge_time").isNotNull()
    )
    days_to_death = boundary_diff("day", "icu_intime", "death_time")
    return c.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        F.col("icu_intime").alias("index_date"),
        "icu_outtime",
        "icu_los_days",
        "age_at_admission",
        "gender",
        "race",
        "insurance",
        "marital_status",
        F.col("los_days").alias("hospital_los_days"),
        "died_during_admission",
        "mortality_28d",
        flag(F.col("death_time").isNotNull() & (days_to_death <= HORIZON_DAYS)).alias("outcome_mortality_28d"),
        F.when(F.col("death_time").isNotNull(), days_to_death).otherwise(boundary_diff("day", "icu_intime", "discharge_time")).alias("time_to_event_days"),
        flag(F.col("death_time").isNotNull()).alias("event_observed"),
    )


# --------------------------------------------------------------------------- K3
def treatment_flags(cohort: DataFrame, inputevents: DataFrame, d_items: DataFrame) -> DataFrame:
    """Vasopressor vs fluid in the first 24 h of the stay (one row per stay)."""
    items = _lower(d_items).select(_long("itemid").alias("itemid"), "label")
    ie = _lower(inputevents).select(
        _long("stay_id").alias("stay_id"), _long("itemid").alias("itemid"), _ts("starttime").alias("starttime"), F.col("amount").try_cast("double").alias("amount"), "amountuom"
    )
    # d_items is a dictionary table (one row per item): broadcast after a size check
    # only the listed items can be an arm: filter them before the join (reaches the scan)
    ie = ie.where(F.col("itemid").isin(VASOPRESSOR_ITEMS + FLUID_ITEMS))
    labeled = ie.join(broadcast_if_small(items, 1_000_000), "itemid").withColumn("input_category", categorize("itemid", {"vasopressor": VASOPRESSOR_ITEMS, "fluid": FLUID_ITEMS}))
    flags = exposure_flags(
        cohort.select("stay_id", "index_date"),
        labeled,
        unit_id="stay_id",
        key="stay_id",
        index_ts="index_date",
        event_ts="starttime",
        category="input_category",
        exposed="vasopressor",
        comparator="fluid",
        amount="amount",
        item="itemid",
        lo_hours=0,
        hi_hours=EXPOSURE_HOURS,
        unit_col="amountuom",
        unit_value="ml",
        labels=ARM_LABELS,
        names={
            "received_exposed": "received_vasopressor",
            "received_comparator": "received_fluid",
            "total_amount": "total_fluid_ml",
            "exposed_count": "vasopressor_count",
            "first_exposed_time": "first_vasopressor_time",
        },
    )
    ids = cohort.select("stay_id", "subject_id", "hadm_id")
    return ids.join(flags, "stay_id").select(
        "subject_id",
        "hadm_id",
        "stay_id",
        "index_date",
        "received_vasopressor",
        "received_fluid",
        "total_fluid_ml",
        "vasopressor_count",
        "first_vasopressor_time",
        "treatment_group",
        "treatment_label",
    )


# --------------------------------------------------------------------------- K4 / K5
def lab_covariates(cohort: DataFrame, labevents: DataFrame) -> DataFrame:
    """First valid (> 0) lab value per item in the first 6 h after the index."""
    le = _lower(labevents).select(_long("labevent_id").alias("labevent_id"), _long("hadm_id").alias("hadm_id"), _long("itemid").alias("itemid"), _ts("charttime").alias("charttime"), F.col("valuenum").try_cast("double").alias("valuenum"))
    return baseline_covariates(cohort.select("stay_id", "hadm_id", "index_date"), le, "stay_id", "hadm_id", "index_date", "charttime", "itemid", "valuenum", LAB_ITEMS, "labevent_id", 0, LAB_HOURS)


def analysis_cohort(patients: DataFrame, admissions: DataFrame, diagnoses: DataFrame, icustays: DataFrame, inputevents: DataFrame, d_items: DataFrame, labevents: DataFrame, checkpoint: bool = True) -> DataFrame:
    """The analysis mart: one row per first ICU stay that received either arm."""
    coh = sepsis_cohort(patients, admissions, diagnoses, icustays)
    if checkpoint:
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(coh.sparkSession)
        coh = coh.checkpoint(eager=True)
    t = treatment_flags(coh, inputevents, d_items).select("stay_id", "treatment_group", "treatment_label", "total_fluid_ml", "vasopressor_count")
    mart = analysis_mart(coh, t, lab_covariates(coh, labevents), "stay_id")
    return mart.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        "index_date",
        "treatment_group",
        "treatment_label",
        "total_fluid_ml",
        "vasopressor_count",
        "outcome_mortality_28d",
        "time_to_event_days",
        "event_observed",
        "age_at_admission",
        "gender",
        "race",
        "insurance",
        "icu_los_days",
        "hospital_los_days",
        *LAB_ITEMS.keys(),
    )


CONTINUOUS_COVARIATES = ["age_at_admission", "icu_los_days", "total_fluid_ml", *LAB_ITEMS.keys()]
CATEGORICAL_COVARIATES = ["gender", "race", "insurance"]
COX_COVARIATES = ["treatment_group", *CONTINUOUS_COVARIATES]
