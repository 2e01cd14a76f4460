"""Model-stage operators on deterministic scores, so that SQL can check them.

The score of a unit is its age role; nothing is fitted. Matching is forced
into many chunks, and the reports run on the matched cohort it gives.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import band
from ..operators import balance, cox, describe, interpret, matching, quality, survival
from ..sources import io
from . import study
from .oracle_sql import with_mart, with_mart_and
from .registry import register

CALIPER = 150.0
CHUNK_ROWS = 60
SHOWN = study.CONTINUOUS

#: Treated in ascending (score, id) order each take the nearest control not yet used, ties to the lowest id.
MATCH_CTES = f"""
tr AS (SELECT stay_id, age_at_admission AS x, row_number() OVER (ORDER BY age_at_admission, stay_id) AS k FROM mart WHERE treatment_group = 1 AND age_at_admission IS NOT NULL),
co AS (SELECT stay_id, age_at_admission AS x FROM mart WHERE treatment_group = 0 AND age_at_admission IS NOT NULL),
walk AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS tid, NULL::BIGINT AS cid, NULL::DOUBLE AS distance, []::BIGINT[] AS used
  UNION ALL
  SELECT t.k, t.stay_id, b.cid, b.distance, CASE WHEN b.cid IS NULL THEN w.used ELSE list_append(w.used, b.cid) END
  FROM walk w JOIN tr t ON t.k = w.k + 1
  LEFT JOIN LATERAL (
    SELECT c.stay_id AS cid, abs(c.x - t.x) AS distance FROM co c
    WHERE NOT list_contains(w.used, c.stay_id) AND abs(c.x - t.x) <= {CALIPER}
    ORDER BY abs(c.x - t.x), c.stay_id LIMIT 1
  ) b ON true
),
pairs AS (SELECT row_number() OVER (ORDER BY k) - 1 AS match_id, tid AS treated_id, cid AS control_id, distance FROM walk WHERE cid IS NOT NULL),
members AS (SELECT match_id, treated_id AS stay_id FROM pairs UNION ALL SELECT match_id, control_id FROM pairs),
matched AS (SELECT m.*, p.match_id FROM mart m JOIN members p USING (stay_id))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _on_matched(body: str) -> str:
    return _recursive(with_mart_and(MATCH_CTES, body))


def _pairs(spark, sf):
    mart = study.shared_mart(spark, sf).withColumn("x", F.col("age_at_admission").cast("double"))
    return matching.match_nearest(mart, "stay_id", "treatment_group", "x", CALIPER, rows_per_chunk=CHUNK_ROWS)


def _matched(spark, sf):
    return matching.matched_cohort(study.shared_mart(spark, sf), _pairs(spark, sf), "stay_id")


@register("match_fixed_score", "match_id:i, treated_id:i, control_id:i, distance:d", _on_matched("SELECT * FROM pairs"))
def q_pairs(spark, sf):
    return _pairs(spark, sf)


@register("match_text_ids", "match_id:i, treated_id:s, control_id:s, distance:d", _recursive(with_mart_and(
    MATCH_CTES.replace("stay_id, stay_id", "stay_id"), "SELECT match_id, 'u' || lpad(CAST(treated_id AS VARCHAR), 12, '0') AS treated_id, 'u' || lpad(CAST(control_id AS VARCHAR), 12, '0') AS control_id, distance FROM pairs")))
def q_text_pairs(spark, sf):
    mart = study.shared_mart(spark, sf).withColumn("x", F.col("age_at_admission").cast("double"))
    mart = mart.withColumn("uid", F.concat(F.lit("u"), F.lpad(F.col("stay_id").cast("string"), 12, "0")))
    return matching.match_nearest(mart, "uid", "treatment_group", "x", CALIPER, rows_per_chunk=CHUNK_ROWS)


def _walk(score: str, stratum: str) -> str:
    """``MATCH_CTES`` for any score, where a pair must agree in ``stratum``."""
    return (
        MATCH_CTES.split("members AS")[0].rstrip().rstrip(",")
        .replace("stay_id, age_at_admission AS x", f"stay_id, {stratum} AS g, {score} AS x").replace("ORDER BY age_at_admission, stay_id", f"ORDER BY {score}, stay_id")
        .replace("age_at_admission IS NOT NULL", f"{score} IS NOT NULL").replace("WHERE NOT list_contains", "WHERE c.g IS NOT DISTINCT FROM t.g AND NOT list_contains")
    )


#: A third of all units share one score, the others lie on a grid.
DENSE = "CASE WHEN stay_id % 3 = 0 THEN 900.0::DOUBLE ELSE round(age_at_admission / 50.0) * 50.0 END"


@register("match_dense_score", "treated_id:i, control_id:i, distance:d", _recursive(with_mart_and(_walk(DENSE, "1"), "SELECT treated_id, control_id, distance FROM pairs")))
def q_dense_pairs(spark, sf):
    mart = study.shared_mart(spark, sf)
    x = F.when(F.col("stay_id") % 3 == 0, F.lit(900.0)).otherwise(F.round(F.col("age_at_admission") / 50.0) * 50.0)
    return matching.match_nearest(mart.withColumn("x", x), "stay_id", "treatment_group", "x", CALIPER, rows_per_chunk=CHUNK_ROWS)


@register("match_exact_on", "treated_id:i, control_id:i, distance:d", _recursive(with_mart_and(_walk("age_at_admission", "insurance"), "SELECT treated_id, control_id, distance FROM pairs")))
def q_exact_pairs(spark, sf):
    mart = study.shared_mart(spark, sf).withColumn("x", F.col("age_at_admission").cast("double"))
    return matching.match_nearest(mart, "stay_id", "treatment_group", "x", CALIPER, rows_per_chunk=CHUNK_ROWS, exact_on="insurance")


@register("matched_fixed_cohort", "stay_id:i, match_id:i, treatment_group:i, event_observed:i", _on_matched("SELECT stay_id, match_id, treatment_group, event_observed FROM matched"))
def q_members(spark, sf):
    return _matched(spark, sf)


_SIDE = """
SELECT '{c}' AS covariate, avg(CASE WHEN treatment_group = 1 THEN {c} END) AS mean_treated, avg(CASE WHEN treatment_group = 0 THEN {c} END) AS mean_control,
       abs(avg(CASE WHEN treatment_group = 1 THEN {c} END) - avg(CASE WHEN treatment_group = 0 THEN {c} END))
       / sqrt((var_samp(CASE WHEN treatment_group = 1 THEN {c} END) + var_samp(CASE WHEN treatment_group = 0 THEN {c} END)) / 2) AS smd FROM {t}"""


def _sides(table: str) -> str:
    return "\nUNION ALL\n".join(_SIDE.format(c=c, t=table) for c in SHOWN)


@register(
    "balance_fixed_match",
    "covariate:s, mean_treated_before:d, mean_control_before:d, smd_before:d, mean_treated_after:d, mean_control_after:d, smd_after:d, balanced_after:b",
    _recursive(
        with_mart_and(
            MATCH_CTES + f",\nbefore AS ({_sides('mart')}),\nafter AS ({_sides('matched')})",
            "SELECT covariate, b.mean_treated AS mean_treated_before, b.mean_control AS mean_control_before, b.smd AS smd_before, "
            "a.mean_treated AS mean_treated_after, a.mean_control AS mean_control_after, a.smd AS smd_after, a.smd < 0.1 AS balanced_after FROM before b JOIN after a USING (covariate)",
        )
    ),
)
def q_balance(spark, sf):
    return balance.balance_table(study.shared_mart(spark, sf), _matched(spark, sf), SHOWN)


@register("matched_fixed_counts", "treatment_label:s, n:i", _on_matched("SELECT treatment_label, count(*) AS n FROM matched GROUP BY treatment_label"))
def q_counts(spark, sf):
    return describe.value_counts(_matched(spark, sf), "treatment_label")


@register(
    "matched_fixed_rates",
    "treatment_label:s, n_events:d, n:i, rate:d",
    _on_matched("SELECT treatment_label, sum(event_observed) AS n_events, count(event_observed) AS n, avg(event_observed) AS rate FROM matched GROUP BY treatment_label"),
)
def q_rates(spark, sf):
    return describe.rate_by_group(_matched(spark, sf), "treatment_label", "event_observed")


TIMES = [1.0, 2.0, 5.0, 20.0]


@register(
    "at_risk_at",
    "treatment_label:s, time_point:d, n_at_risk:i",
    with_mart(
        "\nUNION ALL\n".join(f"SELECT treatment_label, {t} AS time_point, count_if(time_to_event_days >= {t}) AS n_at_risk FROM mart WHERE time_to_event_days IS NOT NULL AND event_observed IS NOT NULL GROUP BY treatment_label" for t in TIMES)
    ),
)
def q_at_risk(spark, sf):
    km = survival.kaplan_meier(study.shared_mart(spark, sf), "time_to_event_days", "event_observed", "treatment_label")
    return survival.at_risk_at(km, TIMES, "treatment_label")


@register(
    "kaplan_meier_null_group",
    "race:s, time:i, n_at_risk:i, events:i, censored:i",
    with_mart(
        """, u AS (SELECT nullif(race, 'ASIA') AS race, time_to_event_days AS t, event_observed AS e FROM mart WHERE time_to_event_days IS NOT NULL AND event_observed IS NOT NULL)
        SELECT a.race, a.t AS time, (SELECT count(*) FROM u b WHERE b.race IS NOT DISTINCT FROM a.race AND b.t >= a.t) AS n_at_risk, sum(a.e) AS events, count(*) - sum(a.e) AS censored
        FROM u a GROUP BY a.race, a.t"""
    ),
)
def q_km_null(spark, sf):
    mart = study.shared_mart(spark, sf).withColumn("race", F.nullif(F.col("race"), F.lit("ASIA")))
    return survival.kaplan_meier(mart, "time_to_event_days", "event_observed", "race")


@register(
    "describe_null_group",
    "kind:s, column:s, count:i, mean:d, std:d, min:d, q25:d, median:d, q75:d, max:d",
    """SELECT kind, 'v' AS "column", count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min,
       quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, max(v) AS max
    FROM (SELECT nullif(event_type, 'view') AS kind, CASE WHEN event_id % 3 > 0 THEN 0.0 ELSE value END AS v FROM events) GROUP BY kind""",
)
def q_describe_null(spark, sf):
    """A NULL group, and one value that two thirds of the rows hold."""
    ev = study.load(spark, sf, "events")
    ev = ev.select(F.nullif(F.col("event_type"), F.lit("view")).alias("kind"), F.when(F.col("event_id") % 3 > 0, 0.0).otherwise(F.col("value")).alias("v"))
    return describe.describe(ev, ["v"], by="kind")


def _c_sql(risk: str) -> str:
    return f""", u AS (SELECT stay_id, time_to_event_days AS t, event_observed AS e, CAST({risk} AS DOUBLE) AS r FROM mart
                       WHERE time_to_event_days IS NOT NULL AND event_observed IS NOT NULL AND {risk} IS NOT NULL)
        SELECT (count_if(b.r < a.r) + 0.5 * count_if(b.r = a.r)) / count(*) AS c_index, count(*) AS n_comparable, count_if(b.r < a.r) AS n_concordant, count_if(b.r = a.r) AS n_tied_risk
        FROM u a JOIN u b ON a.e = 1 AND a.stay_id <> b.stay_id AND (b.t > a.t OR (b.t = a.t AND b.e = 0))"""


@register("concordance_two_values", "c_index:d, n_comparable:i, n_concordant:i, n_tied_risk:i", with_mart(_c_sql("treatment_group")))
def q_c_two(spark, sf):
    return survival.concordance(study.shared_mart(spark, sf), "time_to_event_days", "event_observed", "treatment_group")


@register(
    "trim_off_support",
    "stay_id:i, score:d",
    with_mart_and(
        """s AS (SELECT stay_id, treatment_group, CASE WHEN treatment_group = 1 THEN age_at_admission ELSE age_at_admission + 2500 END AS score FROM mart),
        b AS (SELECT greatest(min(score) FILTER (treatment_group = 1), min(score) FILTER (treatment_group = 0)) AS lo,
                     least(max(score) FILTER (treatment_group = 1), max(score) FILTER (treatment_group = 0)) AS hi FROM s)""",
        "SELECT stay_id, score FROM s, b WHERE score BETWEEN lo AND hi",
    ),
)
def q_trim(spark, sf):
    """Arms shifted apart, so that rows lie outside the common support."""
    shifted = F.when(F.col("treatment_group") == 1, F.col("age_at_admission")).otherwise(F.col("age_at_admission") + 2500)
    return balance.trim_common_support(study.shared_mart(spark, sf).withColumn("score", shifted), "score")[0]


@register(
    "band_quantity",
    "label:s, n:i",
    """SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'middle' WHEN l_quantity IS NOT NULL THEN 'high' END AS label, count(*) AS n FROM lineitem GROUP BY 1""",
)
def q_band(spark, sf):
    return describe.value_counts(study.load(spark, sf, "lineitem").select(band("l_quantity", [10, 30], ["low", "middle", "high"]).alias("label")), "label")


@register("verify_tables", "db:s, table:s, exists:b, rows:i, ok:b", with_mart(
    "SELECT 'marts_check' AS db, 'analysis_mart' AS \"table\", true AS \"exists\", count(*) AS rows, true AS ok FROM mart UNION ALL SELECT 'marts_check', 'not_built', false, NULL, false"))
def q_verify(spark, sf):
    """Own database for the run, dropped at the end."""
    import uuid

    from ..session import scratch_path

    db = f"marts_check_{uuid.uuid4().hex[:10]}"
    io.ensure_databases(spark, [db], location=scratch_path(spark, "warehouse"))
    try:
        io.materialize(study.shared_mart(spark, sf), db, "analysis_mart", kind="table")
        rows = [("marts_check", *r[1:]) for r in io.verify_tables(spark, [(db, "analysis_mart"), (db, "not_built")]).collect()]
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.createDataFrame(rows, "db string, table string, exists boolean, rows long, ok boolean")


@register(
    "folds_fixed_cohort",
    "event_observed:i, fold:i, n:i",
    with_mart(
        ", c AS (SELECT event_observed, count(*) AS m FROM mart WHERE event_observed IS NOT NULL GROUP BY 1) "
        "SELECT event_observed, f AS fold, (m + 4 - f) // 5 AS n FROM c, range(5) r(f) WHERE (m + 4 - f) // 5 > 0"
    ),
)
def q_folds(spark, sf):
    """Sizes of stratified folds: each class dealt evenly over five."""
    f = interpret.stratified_folds(study.shared_mart(spark, sf).where("event_observed is not null"), "event_observed", "stay_id", 5, 42)
    return f.groupBy("event_observed", "fold").agg(F.count(F.lit(1)).alias("n"))


DIAGNOSED = study.COX_COVARIATES


@register(
    "covariate_diagnostics",
    "column:s, n_missing:i, n_zero:i",
    with_mart("\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS n_missing, count_if({c} = 0) AS n_zero FROM mart" for c in DIAGNOSED)),
)
def q_diagnostics(spark, sf):
    mart = study.shared_mart(spark, sf)
    return quality.missingness(mart, DIAGNOSED).select("column", "n_missing").join(quality.zero_counts(mart, DIAGNOSED), "column")


SHAPED = ["a", "b", "c"]
_COLUMNS = [
    "o_orderkey AS id", "o_totalprice AS a", "o_orderkey % 7 AS b", "o_custkey % 5 AS c", "o_totalprice / 1000 - 100 AS shap_a",
    "CAST(o_orderkey % 7 - 3 AS DOUBLE) / 8 AS shap_b", "CAST(o_custkey % 5 AS DOUBLE) / 4 AS shap_c", "o_totalprice AS predicted_proba", "o_orderstatus AS flag",
]
_SHAPS = f"(SELECT {', '.join(_COLUMNS)} FROM orders)"


def _given_shaps(spark, sf):
    """Given columns in the place of SHAP values; nothing is fitted."""
    return study.load(spark, sf, "orders").selectExpr(*_COLUMNS)


@register("importance_given_shaps", "feature:s, mean_abs_shap:d", "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, avg(abs(shap_{f})) AS mean_abs_shap FROM {_SHAPS}" for f in SHAPED))
def q_importance(spark, sf):
    return interpret.shap_importance(_given_shaps(spark, sf), SHAPED)


@register("long_given_shaps", "id:i, feature:s, value:d, shap:d", "\nUNION ALL\n".join(f"SELECT id, '{f}' AS feature, {f} AS value, shap_{f} AS shap FROM {_SHAPS}" for f in SHAPED))
def q_long(spark, sf):
    return interpret.shap_long(_given_shaps(spark, sf), SHAPED, "id")


@register(
    "waterfall_given_shaps",
    "which:s, id:i, score:d, feature:s, value:d, shap:d, rank:i, row_flag:s, base_value:d, total:d",
    f"""WITH s AS {_SHAPS}, ext AS (
      (SELECT 'highest' AS which, id FROM s ORDER BY predicted_proba DESC, id LIMIT 1) UNION ALL (SELECT 'lowest', id FROM s ORDER BY predicted_proba, id LIMIT 1)
    ), long AS (""" + "\nUNION ALL\n".join(f"SELECT which, s.id, predicted_proba AS score, '{f}' AS feature, {f} AS value, shap_{f} AS shap, flag AS row_flag, 0.25 + shap_a + shap_b + shap_c AS total FROM s JOIN ext USING (id)" for f in SHAPED) + """)
    SELECT which, id, score, feature, value, shap, row_number() OVER (PARTITION BY id ORDER BY abs(shap) DESC, feature) AS rank, row_flag, 0.25 AS base_value, total FROM long""",
)
def q_waterfall(spark, sf):
    return interpret.explain_rows(_given_shaps(spark, sf), SHAPED, "id", base_value=0.25, show=["flag"])


# ============================================================== Cox at fixed coefficients (C3, C5), nearly as many durations as rows
COX_COEF = (0.2, -0.1)
_ETA = f"({COX_COEF[0]} * a + {COX_COEF[1]} * b)"
_SUMMED = {"s0": "w", "sa": "w * a", "sb": "w * b", "saa": "w * a * a", "sab": "w * a * b", "sbb": "w * b * b"}
COX_CTES = f"""
units AS (
  SELECT o_totalprice AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e, (o_custkey % 10) / 10.0::DOUBLE AS a, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END AS b FROM orders
),
per_t AS (
  SELECT t, count(*) AS n, sum(e) AS d, sum(e * a) AS xa, sum(e * b) AS xb, sum(e * {_ETA}) AS eta,
         {", ".join(f"sum({x}) AS {c}, sum(e * {x}) AS d{c}" for c, x in _SUMMED.items())}
  FROM (SELECT *, exp({_ETA}) AS w FROM units) GROUP BY t
),
risk AS (
  SELECT *, sum(n) OVER (ORDER BY t) - n + (n + 1) / 2.0 AS time_rank, {", ".join(f"sum({c}) OVER (ORDER BY t DESC) AS r{c}" for c in _SUMMED)} FROM per_t
),
phi AS (SELECT t, f, {", ".join(f"r{c} - f * d{c} AS {c}" for c in _SUMMED)} FROM (SELECT *, unnest(range(d::BIGINT)) / d AS f FROM risk WHERE d > 0)),
info AS (
  SELECT (SELECT sum(eta) FROM per_t) - sum(ln(s0)) AS loglik, (SELECT sum(xa) FROM per_t) - sum(sa / s0) AS score_a, (SELECT sum(xb) FROM per_t) - sum(sb / s0) AS score_b,
         sum(saa / s0 - sa * sa / (s0 * s0)) AS iaa, sum(sab / s0 - sa * sb / (s0 * s0)) AS iab, sum(sbb / s0 - sb * sb / (s0 * s0)) AS ibb, (SELECT sum(n) FROM per_t) AS n, (SELECT sum(d) FROM per_t) AS d
  FROM phi
)"""


def _cox_at(spark, sf):
    units = study.load(spark, sf, "orders").select(
        F.col("o_totalprice").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("e"),
        (F.col("o_custkey") % 10 / F.lit(10.0)).alias("a"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("b"),
    )
    return cox.cox_at(units, "t", "e", ["a", "b"], COX_COEF)


@register(
    "cox_fixed_coefficients",
    "n:i, n_events:i, mean_loglik:d, score_a:d, score_b:d, var_a:d, cov_a_b:d, var_b:d",
    f"""WITH {COX_CTES}
SELECT n, d AS n_events, loglik / n AS mean_loglik, score_a, score_b, ibb / (iaa * ibb - iab * iab) AS var_a, -iab / (iaa * ibb - iab * iab) AS cov_a_b, iaa / (iaa * ibb - iab * iab) AS var_b FROM info""",
)
def q_cox_at(spark, sf):
    model, score = _cox_at(spark, sf)
    v = model.variance
    values = [model.n, model.n_events, model.loglik / model.n, float(score[0]), float(score[1]), float(v[0, 0]), float(v[0, 1]), float(v[1, 1])]
    return spark.createDataFrame([values], "n long, n_events long, mean_loglik double, score_a double, score_b double, var_a double, cov_a_b double, var_b double")


@register(
    "schoenfeld_fixed_coefficients",
    "duration:d, a:d, b:d, time_rank:d, r_a:d, r_b:d",
    f"""WITH {COX_CTES}, means AS (SELECT t, avg(sa / s0) AS ma, avg(sb / s0) AS mb FROM phi GROUP BY t)
SELECT u.t AS duration, u.a, u.b, r.time_rank, u.a - m.ma AS r_a, u.b - m.mb AS r_b FROM units u JOIN means m ON m.t = u.t JOIN risk r ON r.t = u.t WHERE u.e = 1""",
)
def q_schoenfeld(spark, sf):
    model, _ = _cox_at(spark, sf)
    rows = cox.schoenfeld_residuals(model, with_covariates=True)
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))


@register(
    "ph_test_fixed_coefficients",
    "covariate:s, test_statistic:d",
    f"""WITH {COX_CTES}, means AS (SELECT t, avg(sa / s0) AS ma, avg(sb / s0) AS mb FROM phi GROUP BY t),
residuals AS (SELECT r.time_rank AS g, u.a - m.ma AS ra, u.b - m.mb AS rb FROM units u JOIN means m ON m.t = u.t JOIN risk r ON r.t = u.t WHERE u.e = 1),
v AS (SELECT d, ibb / (iaa * ibb - iab * iab) AS vaa, -iab / (iaa * ibb - iab * iab) AS vab, iaa / (iaa * ibb - iab * iab) AS vbb FROM info),
scaled AS (SELECT g - avg(g) OVER () AS g, d * (ra * vaa + rb * vab) AS sa, d * (ra * vab + rb * vbb) AS sb FROM residuals, v)
SELECT 'a' AS covariate, sum(g * sa) ** 2 / (max(d) * max(vaa) * sum(g * g)) AS test_statistic FROM scaled, v
UNION ALL SELECT 'b', sum(g * sb) ** 2 / (max(d) * max(vbb) * sum(g * g)) FROM scaled, v""",
)
def q_ph_fixed(spark, sf):
    model, _ = _cox_at(spark, sf)
    return spark.createDataFrame(cox.ph_test(model), cox.PH_SCHEMA)
