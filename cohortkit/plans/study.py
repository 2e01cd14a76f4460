"""The reference study re-expressed on the given test tables.

Role map (see FIXTURES.md §2):

* subject            = customer (``c_custkey`` = ``events.user_id``); age role =
                       ``c_acctbal``, race role = region name, insurance role =
                       market segment
* admission          = user-day; admit/discharge = first/last event of the day
* stay / index event = ``signup`` event, first per admission by (ts, event_id);
                       stay end = the user's next event after it
* exposure           = ``click`` in [index, index+24h) -> 1; ``view`` only -> 0
* amount             = ``events.value`` of the comparator (view) events
* baseline values    = first value > 0 per event type in [index, index+72h)
* outcome            = first ``error`` strictly after the index, censored at
                       the user's last event
* diagnosis codes    = orders: ``o_orderstatus`` = version,
                       ``o_orderpriority`` = code
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import categorize, flag_codes, los_days
from ..operators.cohort import (
    add_outcome,
    broadcast_if_small,
    analysis_mart,
    baseline_covariates,
    exposure_flags,
    first_events_after,
    first_per,
    has_any,
)

# Fixed values of the study definition on the test tables.
CATEGORY_MAP = {"exposed": ["click"], "comparator": ["view"]}
COVARIATE_ITEMS = {"v_purchase": "purchase", "v_view": "view", "v_error": "error", "v_click": "click"}
CODE_SETS = {"F": ["1-URGENT", "2-HIGH"], "O": ["1-URGENT"]}
AGE_RANGE = (-500.0, 9500.0)
MIN_STAY_DAYS = 4.0 / 24.0
EXPOSURE_HOURS = 24
BASELINE_HOURS = 72
HORIZON_DAYS = 28
DIMENSION_ROWS = 100_000

CONTINUOUS = ["age_at_admission", "icu_los_days", "total_amount", "v_purchase", "v_view", "v_error", "v_click"]
CATEGORICAL = ["race", "insurance"]
COX_COVARIATES = ["treatment_group"] + CONTINUOUS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the subject key named ``subject_id`` and a category column."""
    return load(spark, sf_dir, "events").withColumnRenamed("user_id", "subject_id").withColumn("category", categorize("event_type", CATEGORY_MAP))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation and region are small dimensions; broadcast after a size check
    nation = broadcast_if_small(load(spark, sf_dir, "nation"), DIMENSION_ROWS)
    region = broadcast_if_small(load(spark, sf_dir, "region"), DIMENSION_ROWS)
    return (
        load(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("subject_id"),
            F.col("c_acctbal").alias("age_at_admission"),
            F.col("r_name").alias("race"),
            F.col("c_mktsegment").alias("insurance"),
        )
    )


def category_levels(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Levels of the categorical roles, read from their dimension tables."""
    race = [r[0] for r in load(spark, sf_dir, "region").select("r_name").distinct().collect()]
    seg = [r[0] for r in load(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect()]
    return {"race": sorted(race), "insurance": sorted(seg)}


def hadm_key(subject: str, ts: str):
    """Admission id of a user-day."""
    return F.col(subject) * F.lit(1_000_000) + F.datediff(F.to_date(F.col(ts)), F.lit("1970-01-01").cast("date"))


def admissions(ev: DataFrame) -> DataFrame:
    return (
        ev.withColumn("hadm_id", hadm_key("subject_id", "ts"))
        .groupBy("hadm_id", "subject_id")
        .agg(F.min("ts").alias("admit_time"), F.max("ts").alias("discharge_time"))
        .withColumn("hospital_los_days", los_days("admit_time", "discharge_time"))
    )


def flagged_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with at least one order whose (status, priority) is in the code set."""
    orders = load(spark, sf_dir, "orders")
    return orders.where(flag_codes("o_orderpriority", "o_orderstatus", CODE_SETS) == 1).select(F.col("o_custkey").alias("subject_id"))


def stays(ev: DataFrame, outcome: bool = False) -> DataFrame:
    """Index events (first signup per admission) with the stay end (next event
    of the user) and, with ``outcome``, the outcome time (next error) — both
    from one as-of pass over the events."""
    signups = ev.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("stay_id"),
        "subject_id",
        hadm_key("subject_id", "ts").alias("hadm_id"),
        F.col("ts").alias("index_date"),
    )
    first = first_per(signups, "hadm_id", ["index_date"], "stay_id")
    outs = {"icu_outtime": None}
    if outcome:
        outs["death_time"] = F.col("event_type") == "error"
    with_end = first_events_after(first, ev, "subject_id", "index_date", "ts", outs, strict=True)
    return with_end.withColumn("icu_los_days", los_days("index_date", "icu_outtime"))


def cohort(spark: SparkSession, sf_dir: str, checkpoint: bool = True) -> DataFrame:
    """Eligible index cohort with outcome columns (K1 + K2)."""
    ev = events(spark, sf_dir)
    st = stays(ev, outcome=True)
    adm = admissions(ev)
    # the user's last event = latest discharge over the user's admissions
    last_seen = adm.groupBy("subject_id").agg(F.max("discharge_time").alias("censor_time"))
    eligible = has_any(subjects(spark, sf_dir), flagged_subjects(spark, sf_dir), "subject_id")
    coh = (
        st.join(adm.drop("subject_id"), on="hadm_id", how="inner")
        .join(eligible, on="subject_id", how="inner")
        .join(last_seen, on="subject_id", how="inner")
        .where(
            (F.col("age_at_admission") >= AGE_RANGE[0])
            & (F.col("age_at_admission") <= AGE_RANGE[1])
            & (F.col("icu_los_days") >= MIN_STAY_DAYS)
            & F.col("admit_time").isNotNull()
            & F.col("discharge_time").isNotNull()
        )
    )
    coh = add_outcome(coh, "index_date", "death_time", "censor_time", HORIZON_DAYS).select(
        "subject_id",
        "hadm_id",
        "stay_id",
        "index_date",
        "icu_outtime",
        "icu_los_days",
        "age_at_admission",
        "race",
        "insurance",
        "hospital_los_days",
        "outcome_mortality_28d",
        "time_to_event_days",
        "event_observed",
    )
    return coh.checkpoint(eager=True) if checkpoint else coh


def treatment(spark: SparkSession, sf_dir: str, coh: DataFrame | None = None) -> DataFrame:
    coh = cohort(spark, sf_dir) if coh is None else coh
    # filter on the raw event type so the restriction reaches the parquet scan
    raw_types = [v for vals in CATEGORY_MAP.values() for v in vals]
    return exposure_flags(
        coh.select("stay_id", "subject_id", "index_date"),
        events(spark, sf_dir).where(F.col("event_type").isin(raw_types)),
        unit_id="stay_id",
        key="subject_id",
        index_ts="index_date",
        event_ts="ts",
        category="category",
        exposed="exposed",
        comparator="comparator",
        amount="value",
        item="event_type",
        lo_hours=0,
        hi_hours=EXPOSURE_HOURS,
    )


def covariates(spark: SparkSession, sf_dir: str, coh: DataFrame | None = None) -> DataFrame:
    coh = cohort(spark, sf_dir) if coh is None else coh
    return baseline_covariates(
        coh.select("stay_id", "subject_id", "index_date"),
        events(spark, sf_dir),
        unit_id="stay_id",
        key="subject_id",
        index_ts="index_date",
        event_ts="ts",
        item="event_type",
        value="value",
        items=COVARIATE_ITEMS,
        tiebreak="event_id",
        lo_hours=0,
        hi_hours=BASELINE_HOURS,
    )


def mart(spark: SparkSession, sf_dir: str, checkpoint: bool = True) -> DataFrame:
    """Analysis mart: one row per unit with an arm (K5)."""
    coh = cohort(spark, sf_dir, checkpoint=checkpoint)
    t = treatment(spark, sf_dir, coh).select("stay_id", "treatment_group", "treatment_label", "total_amount", "exposed_count")
    m = analysis_mart(coh, t, covariates(spark, sf_dir, coh), "stay_id")
    return m.checkpoint(eager=True) if checkpoint else m


# Checkpointed cohort / mart per (session, data): several registered queries
# start from them; the checkpoint lives in the reliable folder.
_SHARED: dict[tuple[str, str], DataFrame] = {}
STUDY_TABLES = ["region", "nation", "customer", "orders", "events"]


def data_key(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the application and of the study's files (path, length, time),
    so changed files are never answered from an earlier result."""
    jvm = spark.sparkContext._jvm
    parts = [spark.sparkContext.applicationId, sf_dir]
    for t in STUDY_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        parts += sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files)
    return "|".join(parts)


def shared_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (data_key(spark, sf_dir), "cohort")
    if key not in _SHARED:
        _SHARED[key] = cohort(spark, sf_dir)
    return _SHARED[key]


def shared_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (data_key(spark, sf_dir), "mart")
    if key not in _SHARED:
        coh = shared_cohort(spark, sf_dir)
        t = treatment(spark, sf_dir, coh).select("stay_id", "treatment_group", "treatment_label", "total_amount", "exposed_count")
        _SHARED[key] = analysis_mart(coh, t, covariates(spark, sf_dir, coh), "stay_id").checkpoint(eager=True)
    return _SHARED[key]
