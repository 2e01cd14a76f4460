"""Registered queries: one per operator of the survey inventory.

Each entry has a Spark builder ``(spark, sf_dir) -> DataFrame``, an output
spec (column name -> kind) and, where SQL can express it, DuckDB oracle SQL.
The same spec shapes both sides, so names and types always agree:

    i -> BIGINT, d -> DOUBLE rounded to 6 places, s -> string,
    t -> timestamp as 'YYYY-MM-DD hh:mm:ss.ffffff', b -> boolean
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import boundary_diff, categorize, flag, flag_codes, los_days
from ..operators import balance, cohort as K, describe as A, quality as Q, survival as S
from . import study
from .oracle_sql import union_per_column, with_mart, with_mart_and

ROUND = 6


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    spec: str
    sql: str | None = None

    def columns(self) -> list[tuple[str, str]]:
        out = []
        for part in self.spec.split(","):
            name, kind = part.strip().rsplit(":", 1)
            out.append((name.strip(), kind.strip()))
        return out

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return canon(self.build(spark, sf_dir), self.columns())

    def oracle(self) -> str | None:
        return None if self.sql is None else wrap(self.sql, self.columns())


def canon(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    exprs = []
    for name, kind in cols:
        c = F.col(f"`{name}`")
        if kind == "i":
            e = c.cast("long")
        elif kind == "d":
            e = F.round(c.cast("double"), ROUND)
        elif kind == "t":
            e = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "b":
            e = c.cast("boolean")
        else:
            e = c.cast("string")
        exprs.append(e.alias(name))
    return df.select(*exprs)


def wrap(sql: str, cols: list[tuple[str, str]]) -> str:
    exprs = []
    for name, kind in cols:
        q = f'q."{name}"'
        if kind == "i":
            e = f"CAST({q} AS BIGINT)"
        elif kind == "d":
            e = f"round(CAST({q} AS DOUBLE), {ROUND})"
        elif kind == "t":
            e = f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')"
        elif kind == "b":
            e = f"CAST({q} AS BOOLEAN)"
        else:
            e = f"CAST({q} AS VARCHAR)"
        exprs.append(f'{e} AS "{name}"')
    return f"SELECT {', '.join(exprs)} FROM (\n{sql}\n) q"


L = study.load
MART = study.shared_mart
CONT = study.CONTINUOUS
REGISTRY: list[Query] = []


def register(name: str, spec: str, sql: str | None = None):
    def deco(fn):
        REGISTRY.append(Query(name, fn, spec, sql))
        return fn

    return deco


# ============================================================== cohort (K1-K6, J, W, P)
COHORT_SPEC = (
    "subject_id:i, hadm_id:i, stay_id:i, index_date:t, icu_outtime:t, icu_los_days:d, age_at_admission:d, race:s, insurance:s, "
    "hospital_los_days:d, outcome_mortality_28d:i, time_to_event_days:i, event_observed:i"
)


@register("cohort", COHORT_SPEC, with_mart("SELECT * FROM cohort"))
def q_cohort(spark, sf):
    return study.shared_cohort(spark, sf)


@register(
    "exposure_flags",
    "stay_id:i, received_exposed:i, received_comparator:i, total_amount:d, exposed_count:i, first_exposed_time:t, treatment_group:i, treatment_label:s",
    with_mart("SELECT * FROM treatment"),
)
def q_exposure(spark, sf):
    return study.treatment(spark, sf, study.shared_cohort(spark, sf))


@register("baseline_covariates", "stay_id:i, v_purchase:d, v_view:d, v_error:d, v_click:d", with_mart("SELECT * FROM covs"))
def q_covs(spark, sf):
    return study.covariates(spark, sf, study.shared_cohort(spark, sf))


MART_SPEC = COHORT_SPEC + ", treatment_group:i, treatment_label:s, total_amount:d, exposed_count:i, v_purchase:d, v_view:d, v_error:d, v_click:d"


@register("analysis_mart", MART_SPEC, with_mart("SELECT * FROM mart"))
def q_mart(spark, sf):
    return MART(spark, sf)


@register(
    "events_in_window",
    "stay_id:i, event_id:i, event_type:s, value:d",
    with_mart(
        "SELECT c.stay_id, e.event_id, e.event_type, e.value FROM cohort c "
        "JOIN ev e ON e.subject_id = c.subject_id AND e.ts >= c.index_date AND e.ts < c.index_date + INTERVAL 24 HOUR"
    ),
)
def q_window(spark, sf):
    coh = study.shared_cohort(spark, sf).select("stay_id", "subject_id", "index_date")
    ev = study.events(spark, sf).select("subject_id", "event_id", "ts", "event_type", "value")
    return K.events_in_window(coh, ev, "subject_id", "index_date", "ts", 0, 24)


@register(
    "first_event_after",
    "stay_id:i, next_error:t, next_other:t",
    """
    SELECT s.event_id AS stay_id,
      (SELECT min(e.ts) FROM events e WHERE e.user_id = s.user_id AND e.ts > s.ts AND e.event_type = 'error') AS next_error,
      (SELECT min(e.ts) FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.ts AND e.event_type <> 'signup') AS next_other
    FROM events s WHERE s.event_type = 'signup'
    """,
)
def q_asof(spark, sf):
    ev = L(spark, sf, "events")
    idx = ev.where(F.col("event_type") == "signup").select(F.col("event_id").alias("stay_id"), "user_id", F.col("ts").alias("t0"))
    a = K.first_event_after(idx, ev.where(F.col("event_type") == "error"), "user_id", "t0", "ts", "next_error", strict=True)
    return K.first_event_after(a, ev.where(F.col("event_type") != "signup"), "user_id", "t0", "ts", "next_other", strict=False)


@register(
    "stage_orders_flags",
    "l_orderkey:i, l_linenumber:i, l_partkey:i, l_suppkey:i, ship_hours:i, ship_days:i, ship_los_days:d, is_returned:i, is_open:i, ship_plus_6h:t",
    """
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
           date_diff('hour', o.o_orderdate, l.l_shipdate) AS ship_hours,
           date_diff('day', o.o_orderdate, l.l_shipdate) AS ship_days,
           CAST(date_diff('hour', o.o_orderdate, l.l_shipdate) AS DOUBLE) / 24.0 AS ship_los_days,
           CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS is_returned,
           CASE WHEN o.o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_open,
           l.l_shipdate + INTERVAL 6 HOUR AS ship_plus_6h
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
    """,
)
def q_stage(spark, sf):
    from ..functions.exprs import add_hours

    li = L(spark, sf, "lineitem")
    o = L(spark, sf, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        boundary_diff("hour", "o_orderdate", "l_shipdate").alias("ship_hours"),
        boundary_diff("day", "o_orderdate", "l_shipdate").alias("ship_days"),
        los_days("o_orderdate", "l_shipdate").alias("ship_los_days"),
        flag(F.col("l_returnflag") == "R").alias("is_returned"),
        flag(F.col("o_orderstatus") == "O").alias("is_open"),
        add_hours("l_shipdate", 6).alias("ship_plus_6h"),
    )


@register(
    "code_flags",
    "o_orderkey:i, is_flagged:i",
    """
    SELECT o_orderkey,
      CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1
           WHEN o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT') THEN 1 ELSE 0 END AS is_flagged
    FROM orders
    """,
)
def q_codes(spark, sf):
    return L(spark, sf, "orders").select("o_orderkey", flag_codes("o_orderpriority", "o_orderstatus", study.CODE_SETS).alias("is_flagged"))


#: Code list and mapping as tables that grow with the data: parts by brand and size, suppliers by nation.
@register(
    "code_flags_table",
    "l_orderkey:i, l_linenumber:i, l_partkey:i, is_flagged:i",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN EXISTS (SELECT 1 FROM part p WHERE p.p_size % 7 = 0 AND p.p_brand <> 'Brand#1' AND p.p_partkey = l_partkey AND l_returnflag = CASE WHEN p.p_size > 25 THEN 'A' ELSE 'R' END) THEN 1 ELSE 0 END AS is_flagged
    FROM lineitem
    """,
)
def q_codes_table(spark, sf):
    codes = L(spark, sf, "part").where("p_size % 7 = 0 AND p_brand <> 'Brand#1'").selectExpr("CASE WHEN p_size > 25 THEN 'A' ELSE 'R' END AS version", "p_partkey AS code")
    lines = L(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return K.flag_by_table(lines, "l_partkey", "l_returnflag", codes, "is_flagged")


@register(
    "categorize_table",
    "l_orderkey:i, l_linenumber:i, l_partkey:i, category:s",
    """
    WITH mapping AS (
      SELECT p_partkey AS k, p_brand AS category, 1 AS precedence FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, p_type, 2 FROM part WHERE p_size % 3 = 0
    ), one AS (SELECT k, arg_min(category, (precedence, category)) AS category FROM mapping GROUP BY k)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(category, 'other') AS category FROM lineitem LEFT JOIN one ON k = l_partkey
    """,
)
def q_categorize_table(spark, sf):
    part = L(spark, sf, "part")
    small = part.where("p_size < 10").selectExpr("p_partkey AS k", "p_brand AS category", "1 AS precedence")
    mapping = small.unionByName(part.where("p_size % 3 = 0").selectExpr("p_partkey AS k", "p_type AS category", "2 AS precedence"))
    return K.categorize_by_table(L(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", mapping, "category")


@register(
    "categorize_events",
    "event_id:i, category:s",
    "SELECT event_id, CASE WHEN event_type IN ('click') THEN 'exposed' WHEN event_type IN ('view') THEN 'comparator' ELSE 'other' END AS category FROM events",
)
def q_categorize(spark, sf):
    return L(spark, sf, "events").select("event_id", categorize("event_type", study.CATEGORY_MAP).alias("category"))


LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register(
    "first_line_per_order",
    "l_orderkey:i, l_linenumber:i, l_partkey:i, l_suppkey:i, l_shipdate:t, l_extendedprice:d",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem
    ) WHERE rn = 1
    """,
)
def q_first_line(spark, sf):
    li = L(spark, sf, "lineitem")
    return K.first_per(li, "l_orderkey", LINE_ORDER[:-1], LINE_ORDER[-1]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


@register(
    "has_any_semi",
    "c_custkey:i, c_mktsegment:s",
    """
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (
      SELECT DISTINCT o_custkey FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
        OR (o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT')))
    """,
)
def q_semi(spark, sf):
    cust = L(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    keys = study.flagged_subjects(spark, sf).select(F.col("subject_id").alias("c_custkey"))
    return K.has_any(cust, keys, "c_custkey")


@register(
    "attrition",
    "step:i, rule:s, n_remaining:i, n_removed:i",
    with_mart_and(
        """
        base AS (
          SELECT st.*, CAST(date_diff('hour', st.index_date, st.icu_outtime) AS DOUBLE) / 24.0 AS los,
                 sj.age_at_admission AS age, st.subject_id IN (SELECT subject_id FROM flagged) AS has_code
          FROM st JOIN subj sj ON sj.subject_id = st.subject_id
        ),
        steps AS (
          SELECT count(*) AS s0,
                 count_if(coalesce(has_code, false)) AS s1,
                 count_if(coalesce(has_code, false) AND coalesce(age >= -500 AND age <= 9500, false)) AS s2,
                 count_if(coalesce(has_code, false) AND coalesce(age >= -500 AND age <= 9500, false) AND coalesce(los >= CAST(4 AS DOUBLE) / 24.0, false)) AS s3
          FROM base
        )""",
        """
        SELECT 0 AS step, 'all rows' AS rule, s0 AS n_remaining, 0 AS n_removed FROM steps
        UNION ALL SELECT 1, 'has code', s1, s0 - s1 FROM steps
        UNION ALL SELECT 2, 'age in range', s2, s1 - s2 FROM steps
        UNION ALL SELECT 3, 'stay >= 4h', s3, s2 - s3 FROM steps
        """,
    ),
)
def q_attrition(spark, sf):
    ev = study.events(spark, sf)
    st = study.stays(ev)
    flagged = study.flagged_subjects(spark, sf).distinct().withColumn("__has", F.lit(True))
    base = st.join(study.subjects(spark, sf), "subject_id").join(flagged, "subject_id", "left")
    rules = [
        ("has code", F.col("__has").isNotNull()),
        ("age in range", (F.col("age_at_admission") >= study.AGE_RANGE[0]) & (F.col("age_at_admission") <= study.AGE_RANGE[1])),
        ("stay >= 4h", F.col("icu_los_days") >= study.MIN_STAY_DAYS),
    ]
    return K.attrition(base, rules)


# ============================================================== quality (P18, P19, IO5, A10, A11, A14)
@register(
    "expect_unique",
    "columns:s, n_rows:i, n_distinct:i, n_duplicate_keys:i, n_duplicate_rows:i, ok:b",
    """
    SELECT 'o_orderkey' AS columns, sum(c) AS n_rows, count(*) AS n_distinct, count_if(c > 1) AS n_duplicate_keys,
           sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS n_duplicate_rows, count_if(c > 1) = 0 AS ok
    FROM (SELECT o_orderkey, count(*) AS c FROM orders GROUP BY o_orderkey)
    UNION ALL
    SELECT 'l_orderkey,l_linenumber', sum(c), count(*), count_if(c > 1), sum(CASE WHEN c > 1 THEN c ELSE 0 END), count_if(c > 1) = 0
    FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
    """,
)
def q_unique(spark, sf):
    return Q.expect_unique(L(spark, sf, "orders"), "o_orderkey").unionByName(Q.expect_unique(L(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag"]


@register(
    "expect_not_null",
    "column:s, n_rows:i, n_null:i, ok:b",
    "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count_if({c} IS NULL) AS n_null, count_if({c} IS NULL) = 0 AS ok FROM lineitem" for c in LI_COLS),
)
def q_not_null(spark, sf):
    return Q.expect_not_null(L(spark, sf, "lineitem"), LI_COLS)


@register(
    "expect_checks",
    "check:s, n_rows:i, n_bad:i, ok:b",
    with_mart(
        """
        SELECT 'duration >= 0' AS "check", count(*) AS n_rows, count_if(NOT coalesce(time_to_event_days >= 0, false)) AS n_bad,
               count_if(NOT coalesce(time_to_event_days >= 0, false)) = 0 AS ok FROM mart
        UNION ALL
        SELECT 'event is 0/1', count(*), count_if(NOT coalesce(event_observed IN (0, 1), false)), count_if(NOT coalesce(event_observed IN (0, 1), false)) = 0 FROM mart
        UNION ALL
        SELECT 'baseline view present', count(*), count_if(NOT coalesce(v_view IS NOT NULL, false)), count_if(NOT coalesce(v_view IS NOT NULL, false)) = 0 FROM mart
        """
    ),
)
def q_expect(spark, sf):
    m = MART(spark, sf)
    return Q.expect(
        m,
        [
            ("duration >= 0", F.col("time_to_event_days") >= 0),
            ("event is 0/1", F.col("event_observed").isin(0, 1)),
            ("baseline view present", F.col("v_view").isNotNull()),
        ],
    )


@register(
    "reconcile_counts",
    "table:s, expected:i, actual:i, ok:b",
    """
    SELECT 'lineitem with order' AS "table", (SELECT count(*) FROM lineitem) AS expected,
           (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS actual,
           (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS ok
    UNION ALL
    SELECT 'events of customers', (SELECT count(*) FROM events),
           (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
           (SELECT count(*) FROM events) = (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer))
    """,
)
def q_reconcile(spark, sf):
    li = L(spark, sf, "lineitem")
    o = L(spark, sf, "orders")
    ev = L(spark, sf, "events")
    c = L(spark, sf, "customer")
    return Q.reconcile_counts(
        [
            ("lineitem with order", li, li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")),
            ("events of customers", ev, ev.join(c.select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")),
        ]
    )


MART_COLS = [c for c, _ in [p.strip().rsplit(":", 1) for p in MART_SPEC.split(",")]]


@register(
    "missingness",
    "column:s, n_missing:i, pct_missing:d",
    with_mart(
        "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", count_if(\"{c}\" IS NULL) AS n_missing, count_if(\"{c}\" IS NULL) * 100.0 / count(*) AS pct_missing FROM mart" for c in MART_COLS)
    ),
)
def q_missing(spark, sf):
    return Q.missingness(MART(spark, sf), MART_COLS)


@register("zero_counts", "column:s, n_zero:i", with_mart(union_per_column("SELECT '{c}' AS \"column\", count_if({c} = 0) AS n_zero FROM mart")))
def q_zero(spark, sf):
    return Q.zero_counts(MART(spark, sf), CONT)


@register("distinct_counts", "column:s, n_distinct:i", with_mart(union_per_column("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM mart")))
def q_distinct(spark, sf):
    return Q.distinct_counts(MART(spark, sf), CONT)


# ============================================================== describe (A7-A17, T3)
DESCRIBE_COLS = CONT + ["time_to_event_days"]


@register(
    "describe_by",
    "treatment_label:s, column:s, count:i, mean:d, std:d, min:d, q25:d, median:d, q75:d, max:d",
    with_mart(
        union_per_column(
            "SELECT treatment_label, '{c}' AS \"column\", count({c}) AS \"count\", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS \"min\", "
            "quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, max({c}) AS \"max\" FROM mart GROUP BY treatment_label",
            DESCRIBE_COLS,
        )
    ),
)
def q_describe(spark, sf):
    return A.describe(MART(spark, sf), DESCRIBE_COLS, by="treatment_label")


@register("value_counts", "event_type:s, n:i", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_value_counts(spark, sf):
    return A.value_counts(L(spark, sf, "events"), "event_type")


@register(
    "rate_by_group",
    "treatment_label:s, n_events:d, n:i, rate:d",
    with_mart("SELECT treatment_label, sum(outcome_mortality_28d) AS n_events, count(outcome_mortality_28d) AS n, avg(outcome_mortality_28d) AS rate FROM mart GROUP BY treatment_label"),
)
def q_rate(spark, sf):
    return A.rate_by_group(MART(spark, sf), "treatment_label", "outcome_mortality_28d")


@register(
    "crosstab_pct",
    "race:s, treatment_label:s, n:i, pct:d",
    with_mart(
        "SELECT race, treatment_label, n, n * 100.0 / sum(n) OVER (PARTITION BY treatment_label) AS pct FROM "
        "(SELECT race, treatment_label, count(*) AS n FROM mart WHERE race IS NOT NULL AND treatment_label IS NOT NULL GROUP BY race, treatment_label)"
    ),
)
def q_crosstab(spark, sf):
    return A.crosstab_pct(MART(spark, sf), "race", "treatment_label")


@register(
    "histogram",
    "treatment_label:s, bin:i, lo:d, hi:d, n:i, density:d",
    with_mart_and(
        """
        x AS (SELECT treatment_label, CAST(age_at_admission AS DOUBLE) AS v FROM mart WHERE age_at_admission IS NOT NULL),
        st0 AS (SELECT treatment_label, min(v) AS mn, max(v) AS mx, count(*) AS cnt FROM x GROUP BY treatment_label),
        st1 AS (SELECT treatment_label, cnt,
                  CASE WHEN mx > mn THEN mn ELSE mn - 0.5 END AS lo0,
                  CASE WHEN mx > mn THEN mx ELSE mx + 0.5 END AS hi0 FROM st0),
        binned AS (SELECT x.treatment_label, CAST(least(floor((x.v - s.lo0) * 30.0 / (s.hi0 - s.lo0)), 29) AS BIGINT) AS bin
                   FROM x JOIN st1 s ON s.treatment_label = x.treatment_label),
        counts AS (SELECT treatment_label, bin, count(*) AS n FROM binned GROUP BY treatment_label, bin),
        grid AS (SELECT s.*, g.bin FROM st1 s, (SELECT range AS bin FROM range(0, 30)) g)""",
        """
        SELECT g.treatment_label, g.bin, g.lo0 + g.bin * ((g.hi0 - g.lo0) / 30.0) AS lo, g.lo0 + (g.bin + 1) * ((g.hi0 - g.lo0) / 30.0) AS hi,
               coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (g.cnt * ((g.hi0 - g.lo0) / 30.0)) AS density
        FROM grid g LEFT JOIN counts c ON c.treatment_label = g.treatment_label AND c.bin = g.bin
        """,
    ),
)
def q_hist(spark, sf):
    return A.histogram(MART(spark, sf), "age_at_admission", "treatment_label", 30)


CORR_COLS = CONT


@register(
    "corr_pairs",
    "col_a:s, col_b:s, corr:d",
    with_mart(
        "\nUNION ALL\n".join(
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM mart" for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1 :]
        )
    ),
)
def q_corr(spark, sf):
    return A.corr_pairs(MART(spark, sf), CORR_COLS)


@register(
    "extreme_rows",
    "which:s, stay_id:i, icu_los_days:d",
    with_mart(
        "(SELECT 'highest' AS which, stay_id, icu_los_days FROM mart WHERE icu_los_days IS NOT NULL ORDER BY icu_los_days DESC, stay_id LIMIT 1) "
        "UNION ALL (SELECT 'lowest', stay_id, icu_los_days FROM mart WHERE icu_los_days IS NOT NULL ORDER BY icu_los_days ASC, stay_id LIMIT 1)"
    ),
)
def q_extreme(spark, sf):
    return A.extreme_rows(MART(spark, sf), "stay_id", "icu_los_days")


@register(
    "sign_summary",
    "n:i, mean:d, n_pos:i, n_neg:i, share_pos:d, share_neg:d",
    "SELECT count(c_acctbal) AS n, avg(c_acctbal) AS mean, count_if(c_acctbal > 0) AS n_pos, count_if(c_acctbal < 0) AS n_neg, "
    "count_if(c_acctbal > 0) / count(c_acctbal) AS share_pos, count_if(c_acctbal < 0) / count(c_acctbal) AS share_neg FROM customer",
)
def q_sign(spark, sf):
    return A.sign_summary(L(spark, sf, "customer"), "c_acctbal")


@register(
    "top_k",
    "l_orderkey:i, l_linenumber:i, l_partkey:i, l_extendedprice:d",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10",
)
def q_topk(spark, sf):
    return A.top_k(L(spark, sf, "lineitem"), "l_extendedprice", 10, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


# ============================================================== balance (B1, M1-M3, M6)
SMD_SQL = """
SELECT covariate, treated_mean, control_mean, treated_n, control_n,
       abs(treated_mean - control_mean) / nullif(sqrt((v1 + v0) / 2.0), 0) AS smd
FROM ({inner})
"""
SMD_ROW = (
    "SELECT '{c}' AS covariate, avg(CASE WHEN {t} = 1 THEN {c} END) AS treated_mean, avg(CASE WHEN {t} = 0 THEN {c} END) AS control_mean, "
    "count(CASE WHEN {t} = 1 THEN {c} END) AS treated_n, count(CASE WHEN {t} = 0 THEN {c} END) AS control_n, "
    "var_samp(CASE WHEN {t} = 1 THEN {c} END) AS v1, var_samp(CASE WHEN {t} = 0 THEN {c} END) AS v0 FROM {src}"
)
SMD_SPEC = "covariate:s, treated_mean:d, control_mean:d, treated_n:i, control_n:i, smd:d"


@register("smd_table", SMD_SPEC, with_mart(SMD_SQL.format(inner="\nUNION ALL\n".join(SMD_ROW.format(c=c, t="treatment_group", src="mart") for c in CONT))))
def q_smd(spark, sf):
    return balance.smd_table(MART(spark, sf), CONT, "treatment_group")


LI_SMD_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "smd_lineitem",
    SMD_SPEC,
    "WITH li AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 0 END AS arm FROM lineitem)\n"
    + SMD_SQL.format(inner="\nUNION ALL\n".join(SMD_ROW.format(c=c, t="arm", src="li") for c in LI_SMD_COLS)),
)
def q_smd_li(spark, sf):
    li = L(spark, sf, "lineitem").withColumn("arm", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0))
    return balance.smd_table(li, LI_SMD_COLS, "arm")


@register(
    "impute_median",
    "stay_id:i, " + ", ".join(f"{c}:d" for c in CONT),
    with_mart("SELECT stay_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM mart)) AS {c}" for c in CONT) + " FROM mart"),
)
def q_impute(spark, sf):
    out, _ = balance.impute_median(MART(spark, sf), CONT)
    return out


@register("medians", "column:s, median:d", with_mart(union_per_column("SELECT '{c}' AS \"column\", quantile_cont({c}, 0.5) AS median FROM mart")))
def q_medians(spark, sf):
    med = balance.medians(MART(spark, sf), CONT)
    return spark.createDataFrame([(c, med[c]) for c in CONT], "column string, median double")


RACE_LEVELS = ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
INS_LEVELS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _dummy_name(col: str, lvl: str) -> str:
    return f"{col}_{lvl}"


@register(
    "one_hot",
    "stay_id:i, " + ", ".join(f"{_dummy_name('race', v)}:d" for v in RACE_LEVELS) + ", " + ", ".join(f"{_dummy_name('insurance', v)}:d" for v in INS_LEVELS),
    with_mart(
        "SELECT stay_id, "
        + ", ".join(f"CASE WHEN race = '{v}' THEN 1.0 ELSE 0.0 END AS \"race_{v}\"" for v in RACE_LEVELS)
        + ", "
        + ", ".join(f"CASE WHEN insurance = '{v}' THEN 1.0 ELSE 0.0 END AS \"insurance_{v}\"" for v in INS_LEVELS)
        + " FROM mart"
    ),
)
def q_onehot(spark, sf):
    out, _ = balance.one_hot(MART(spark, sf), ["race", "insurance"], levels=study.category_levels(spark, sf))
    return out


SCORE_CTE = """
scored AS (
  SELECT stay_id, treatment_group,
         (age_at_admission - (SELECT min(age_at_admission) FROM mart)) /
         ((SELECT max(age_at_admission) FROM mart) - (SELECT min(age_at_admission) FROM mart)) AS score
  FROM mart
)"""


def _scored(spark, sf):
    m = MART(spark, sf)
    r = m.agg(F.min("age_at_admission").alias("a"), F.max("age_at_admission").alias("b")).first()
    return m.withColumn("score", (F.col("age_at_admission") - F.lit(r["a"])) / F.lit(r["b"] - r["a"]))


@register(
    "trim_common_support",
    "stay_id:i, treatment_group:i, score:d",
    with_mart_and(
        SCORE_CTE
        + """,
        bounds AS (SELECT greatest(min(CASE WHEN treatment_group = 1 THEN score END), min(CASE WHEN treatment_group = 0 THEN score END)) AS lo,
                          least(max(CASE WHEN treatment_group = 1 THEN score END), max(CASE WHEN treatment_group = 0 THEN score END)) AS hi FROM scored)""",
        "SELECT s.stay_id, s.treatment_group, s.score FROM scored s, bounds b WHERE s.score BETWEEN b.lo AND b.hi",
    ),
)
def q_trim(spark, sf):
    out, _ = balance.trim_common_support(_scored(spark, sf), "score", "treatment_group")
    return out.select("stay_id", "treatment_group", "score")


@register(
    "caliper",
    "n:i, sd_logit:d, caliper:d",
    with_mart_and(
        SCORE_CTE
        + """,
        lg AS (SELECT ln(least(greatest(score, 1e-12), 1 - 1e-12) / (1 - least(greatest(score, 1e-12), 1 - 1e-12))) AS x FROM scored)""",
        "SELECT count(x) AS n, stddev_samp(x) AS sd_logit, stddev_samp(x) * 0.2 AS caliper FROM lg",
    ),
)
def q_caliper(spark, sf):
    return balance.caliper_frame(_scored(spark, sf), "score", 0.2)


# ============================================================== survival (S1-S4, C6, G3)
KM_CTES = """
per_t AS (
  SELECT treatment_label, time_to_event_days AS time, count(*) AS n_t, sum(event_observed) AS events
  FROM mart WHERE time_to_event_days IS NOT NULL AND event_observed IS NOT NULL GROUP BY treatment_label, time_to_event_days
),
risk AS (
  SELECT *, sum(n_t) OVER (PARTITION BY treatment_label ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_at_risk
  FROM per_t
),
km0 AS (
  SELECT *, n_t - events AS censored,
         max(CASE WHEN events >= n_at_risk THEN 1 ELSE 0 END) OVER w AS dead,
         sum(CASE WHEN events < n_at_risk THEN ln(1.0 - CAST(events AS DOUBLE) / n_at_risk) ELSE 0.0 END) OVER w AS logs,
         sum(CASE WHEN n_at_risk > events THEN CAST(events AS DOUBLE) / (CAST(n_at_risk AS DOUBLE) * (n_at_risk - events)) ELSE 0.0 END) OVER w AS var_greenwood
  FROM risk
  WINDOW w AS (PARTITION BY treatment_label ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
km AS (
  SELECT treatment_label, time, n_at_risk, events, censored,
         CASE WHEN dead = 1 THEN 0.0 ELSE exp(logs) END AS survival, var_greenwood FROM km0
)"""


@register(
    "kaplan_meier",
    "treatment_label:s, time:i, n_at_risk:i, events:i, censored:i, survival:d, ci_lower:d, ci_upper:d, var_greenwood:d",
    with_mart_and(
        KM_CTES,
        f"""
        SELECT treatment_label, time, n_at_risk, events, censored, survival,
          CASE WHEN survival > 0 AND survival < 1 THEN exp(-exp(ln(-ln(survival)) - {S.Z95!r} * sqrt(var_greenwood) / ln(survival))) ELSE survival END AS ci_lower,
          CASE WHEN survival > 0 AND survival < 1 THEN exp(-exp(ln(-ln(survival)) + {S.Z95!r} * sqrt(var_greenwood) / ln(survival))) ELSE survival END AS ci_upper,
          var_greenwood
        FROM km
        """,
    ),
)
def q_km(spark, sf):
    return S.kaplan_meier(MART(spark, sf), "time_to_event_days", "event_observed", "treatment_label")


TIME_POINTS = [1.0, 2.0, 3.0, 7.0, 14.0, 28.0]


@register(
    "survival_at",
    "treatment_label:s, time_point:d, survival:d",
    with_mart_and(
        KM_CTES + ",\ntp AS (SELECT unnest([" + ", ".join(repr(t) for t in TIME_POINTS) + "]) AS time_point),\ngroups AS (SELECT DISTINCT treatment_label FROM km)",
        """
        SELECT g.treatment_label, tp.time_point,
               coalesce((SELECT arg_max(k.survival, k.time) FROM km k WHERE k.treatment_label = g.treatment_label AND k.time <= tp.time_point), 1.0) AS survival
        FROM groups g, tp
        """,
    ),
)
def q_surv_at(spark, sf):
    km = S.kaplan_meier(MART(spark, sf), "time_to_event_days", "event_observed", "treatment_label")
    return S.survival_at(km, TIME_POINTS, "treatment_label")


@register(
    "logrank",
    "observed_1:d, expected_1:d, variance:d, chi2:d",
    with_mart_and(
        """
        pt AS (SELECT time_to_event_days AS time, count(*) AS n_t, count_if(treatment_group = 1) AS n1_t, sum(event_observed) AS d,
                      sum(CASE WHEN treatment_group = 1 THEN event_observed ELSE 0 END) AS d1
               FROM mart WHERE time_to_event_days IS NOT NULL AND event_observed IS NOT NULL AND treatment_group IS NOT NULL GROUP BY time_to_event_days),
        rk AS (SELECT *, CAST(sum(n_t) OVER w AS DOUBLE) AS n, CAST(sum(n1_t) OVER w AS DOUBLE) AS n1 FROM pt
               WINDOW w AS (ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        s AS (SELECT CAST(sum(d1) AS DOUBLE) AS observed_1, sum(d * n1 / n) AS expected_1,
                     sum(CASE WHEN n > 1 THEN n1 * (n - n1) * d * (n - d) / (n * n * (n - 1.0)) ELSE 0.0 END) AS variance FROM rk)""",
        "SELECT observed_1, expected_1, variance, (observed_1 - expected_1) * (observed_1 - expected_1) / variance AS chi2 FROM s",
    ),
)
def q_logrank(spark, sf):
    return S.logrank_stats(MART(spark, sf), "time_to_event_days", "event_observed", "treatment_group", 1)


@register(
    "median_time_to_event",
    "treatment_label:s, n:i, median_days:d, mean_days:d",
    with_mart("SELECT treatment_label, count(time_to_event_days) AS n, quantile_cont(time_to_event_days, 0.5) AS median_days, avg(time_to_event_days) AS mean_days FROM mart GROUP BY treatment_label"),
)
def q_median_tte(spark, sf):
    d = A.describe(MART(spark, sf), ["time_to_event_days"], by="treatment_label")
    return d.select("treatment_label", F.col("count").alias("n"), F.col("median").alias("median_days"), F.col("mean").alias("mean_days"))


@register(
    "concordance",
    "c_index:d, n_comparable:i, n_concordant:i, n_tied_risk:i",
    with_mart_and(
        "u AS (SELECT CAST(time_to_event_days AS DOUBLE) AS t, event_observed AS e, CAST(age_at_admission AS DOUBLE) AS r FROM mart "
        "WHERE time_to_event_days IS NOT NULL AND event_observed IS NOT NULL AND age_at_admission IS NOT NULL)",
        """
        SELECT (count_if(b.r < a.r) + 0.5 * count_if(b.r = a.r)) / count(*) AS c_index, count(*) AS n_comparable,
               count_if(b.r < a.r) AS n_concordant, count_if(b.r = a.r) AS n_tied_risk
        FROM u a JOIN u b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0))
        """,
    ),
)
def q_concordance(spark, sf):
    return S.concordance(MART(spark, sf), "time_to_event_days", "event_observed", "age_at_admission")


@register(
    "roc_auc",
    "auc:d, n_pairs:i",
    """
    WITH u AS (SELECT CAST(d.n_chars AS DOUBLE) AS s, l.quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IN (0, 1))
    SELECT (count_if(p.s > n.s) + 0.5 * count_if(p.s = n.s)) / count(*) AS auc, count(*) AS n_pairs
    FROM u p JOIN u n ON p.y = 1 AND n.y = 0
    """,
)
def q_auc(spark, sf):
    docs = L(spark, sf, "documents").select("doc_id", "n_chars")
    labels = L(spark, sf, "labels").select("doc_id", "quality")
    return S.roc_auc(docs.join(labels, "doc_id"), "n_chars", "quality")


# ============================================================== more reports
@register(
    "love_plot",
    "covariate:s, smd:d, above_threshold:b",
    with_mart(
        "SELECT covariate, smd, smd > 0.1 AS above_threshold FROM ("
        + SMD_SQL.format(inner="\nUNION ALL\n".join(SMD_ROW.format(c=c, t="treatment_group", src="mart") for c in CONT))
        + ")"
    ),
)
def q_love(spark, sf):
    return balance.love_plot(balance.smd_table(MART(spark, sf), CONT, "treatment_group"))


PIVOT_FLAGS = {"qty_a": "A", "qty_n": "N", "qty_r": "R"}


@register(
    "pivot_first",
    "l_orderkey:i, qty_a:d, qty_n:d, qty_r:d",
    f"""
    SELECT l_orderkey,
      max(CASE WHEN l_returnflag = 'A' AND rn = 1 THEN l_quantity END) AS qty_a,
      max(CASE WHEN l_returnflag = 'N' AND rn = 1 THEN l_quantity END) AS qty_n,
      max(CASE WHEN l_returnflag = 'R' AND rn = 1 THEN l_quantity END) AS qty_r
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem)
    WHERE l_returnflag IN ('A', 'N', 'R')
    GROUP BY l_orderkey
    """,
)
def q_pivot_first(spark, sf):
    li = L(spark, sf, "lineitem")
    return K.pivot_first(li, "l_orderkey", "l_returnflag", "l_quantity", LINE_ORDER, PIVOT_FLAGS)


@register(
    "sequence_number",
    "stay_id:i, hadm_id:i, seq:i",
    with_mart(
        "SELECT event_id AS stay_id, hadm_id, row_number() OVER (PARTITION BY hadm_id ORDER BY ts, event_id) AS seq "
        "FROM ev WHERE event_type = 'signup'"
    ),
)
def q_seq(spark, sf):
    ev = study.events(spark, sf).where(F.col("event_type") == "signup")
    s = ev.select(F.col("event_id").alias("stay_id"), study.hadm_key("subject_id", "ts").alias("hadm_id"), "ts")
    return K.sequence_number(s, "hadm_id", ["ts"], "stay_id", "seq")


@register(
    "administrative_censor",
    "stay_id:i, time_to_event_days:i, event_observed:i",
    with_mart(
        "SELECT stay_id, CASE WHEN time_to_event_days > 7 THEN 7 ELSE time_to_event_days END AS time_to_event_days, "
        "CASE WHEN time_to_event_days > 7 THEN 0 ELSE event_observed END AS event_observed FROM mart"
    ),
)
def q_admin_censor(spark, sf):
    m = MART(spark, sf).select("stay_id", "time_to_event_days", "event_observed")
    return K.administrative_censor(m, "time_to_event_days", "event_observed", 7)


@register(
    "age_at",
    "o_orderkey:i, age:i",
    """
    SELECT o.o_orderkey, (c.c_nationkey + 20) + (year(o.o_orderdate) - 1995) AS age
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    """,
)
def q_age_at(spark, sf):
    """P8 on the given tables: anchor age = nation key + 20 at anchor year 1995,
    admission time = the order date as text (parsed safely)."""
    from ..functions.exprs import age_at

    o = L(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("admit_text"))
    c = L(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") + 20).alias("anchor_age"))
    j = o.join(c, "o_custkey").withColumn("anchor_year", F.lit(1995))
    return j.select("o_orderkey", age_at("anchor_age", "admit_text", "anchor_year").alias("age"))
