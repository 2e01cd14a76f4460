"""Independent DuckDB SQL for the study on the test tables.

Written straight from the study definition (plain joins, correlated
subqueries, ``row_number``), not from the Spark operators, so that it can act
as the oracle. ``MART_CTES`` defines ``ev``, ``cohort``, ``treatment``,
``covs`` and ``mart``.
"""

from __future__ import annotations

from .study import CONTINUOUS

MART_CTES = """
ev AS (
  SELECT event_id, ts, user_id AS subject_id, event_type, value,
         user_id * 1000000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS hadm_id
  FROM events
),
signups AS (
  SELECT event_id AS stay_id, subject_id, hadm_id, ts AS index_date,
         row_number() OVER (PARTITION BY hadm_id ORDER BY ts, event_id) AS rn
  FROM ev WHERE event_type = 'signup'
),
st AS (
  SELECT s.stay_id, s.subject_id, s.hadm_id, s.index_date,
         (SELECT min(e.ts) FROM ev e WHERE e.subject_id = s.subject_id AND e.ts > s.index_date) AS icu_outtime,
         (SELECT min(e.ts) FROM ev e WHERE e.subject_id = s.subject_id AND e.ts > s.index_date AND e.event_type = 'error') AS death_time
  FROM signups s WHERE s.rn = 1
),
adm AS (SELECT hadm_id, min(ts) AS admit_time, max(ts) AS discharge_time FROM ev GROUP BY hadm_id),
last_seen AS (SELECT subject_id, max(ts) AS censor_time FROM ev GROUP BY subject_id),
subj AS (
  SELECT c.c_custkey AS subject_id, c.c_acctbal AS age_at_admission, r.r_name AS race, c.c_mktsegment AS insurance
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
),
flagged AS (
  SELECT DISTINCT o_custkey AS subject_id FROM orders
  WHERE (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
     OR (o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT'))
),
coh0 AS (
  SELECT st.*,
         CAST(date_diff('hour', st.index_date, st.icu_outtime) AS DOUBLE) / 24.0 AS icu_los_days,
         a.admit_time, a.discharge_time,
         CAST(date_diff('hour', a.admit_time, a.discharge_time) AS DOUBLE) / 24.0 AS hospital_los_days,
         sj.age_at_admission, sj.race, sj.insurance, ls.censor_time
  FROM st
  JOIN adm a ON a.hadm_id = st.hadm_id
  JOIN subj sj ON sj.subject_id = st.subject_id
  JOIN last_seen ls ON ls.subject_id = st.subject_id
  WHERE st.subject_id IN (SELECT subject_id FROM flagged)
),
cohort AS (
  SELECT subject_id, hadm_id, stay_id, index_date, icu_outtime, icu_los_days, age_at_admission, race, insurance, hospital_los_days,
         CASE WHEN death_time IS NOT NULL AND date_diff('day', index_date, death_time) <= 28 THEN 1 ELSE 0 END AS outcome_mortality_28d,
         CASE WHEN death_time IS NOT NULL THEN date_diff('day', index_date, death_time)
              ELSE date_diff('day', index_date, censor_time) END AS time_to_event_days,
         CASE WHEN death_time IS NOT NULL THEN 1 ELSE 0 END AS event_observed
  FROM coh0
  WHERE age_at_admission >= -500 AND age_at_admission <= 9500
    AND icu_los_days >= CAST(4 AS DOUBLE) / 24.0
    AND admit_time IS NOT NULL AND discharge_time IS NOT NULL
),
flags AS (
  SELECT c.stay_id,
         max(CASE WHEN e.event_type = 'click' THEN 1 ELSE 0 END) AS rx,
         max(CASE WHEN e.event_type = 'view' THEN 1 ELSE 0 END) AS rc,
         sum(CASE WHEN e.event_type = 'view' THEN e.value ELSE 0 END) AS amt,
         count(DISTINCT CASE WHEN e.event_type = 'click' THEN e.event_type END) AS cnt,
         min(CASE WHEN e.event_type = 'click' THEN e.ts END) AS first_exposed_time
  FROM cohort c
  JOIN ev e ON e.subject_id = c.subject_id AND e.ts >= c.index_date AND e.ts < c.index_date + INTERVAL 24 HOUR
  WHERE e.event_type IN ('click', 'view')
  GROUP BY c.stay_id
),
treatment AS (
  SELECT c.stay_id,
         coalesce(f.rx, 0) AS received_exposed,
         coalesce(f.rc, 0) AS received_comparator,
         coalesce(f.amt, 0) AS total_amount,
         coalesce(f.cnt, 0) AS exposed_count,
         f.first_exposed_time,
         CASE WHEN coalesce(f.rx, 0) = 1 THEN 1
              WHEN coalesce(f.rx, 0) = 0 AND coalesce(f.rc, 0) = 1 THEN 0 END AS treatment_group,
         CASE WHEN coalesce(f.rx, 0) = 1 THEN 'exposed'
              WHEN coalesce(f.rx, 0) = 0 AND coalesce(f.rc, 0) = 1 THEN 'comparator'
              ELSE 'neither' END AS treatment_label
  FROM cohort c LEFT JOIN flags f ON f.stay_id = c.stay_id
),
ranked AS (
  SELECT c.stay_id, e.event_type, e.value,
         row_number() OVER (PARTITION BY c.stay_id, e.event_type ORDER BY e.ts, e.event_id) AS rn
  FROM cohort c
  JOIN ev e ON e.subject_id = c.subject_id AND e.ts >= c.index_date AND e.ts < c.index_date + INTERVAL 72 HOUR
  WHERE e.event_type IN ('purchase', 'view', 'error', 'click') AND e.value IS NOT NULL AND e.value > 0
),
covs AS (
  SELECT stay_id,
         max(CASE WHEN event_type = 'purchase' AND rn = 1 THEN value END) AS v_purchase,
         max(CASE WHEN event_type = 'view' AND rn = 1 THEN value END) AS v_view,
         max(CASE WHEN event_type = 'error' AND rn = 1 THEN value END) AS v_error,
         max(CASE WHEN event_type = 'click' AND rn = 1 THEN value END) AS v_click
  FROM ranked GROUP BY stay_id
),
mart AS (
  SELECT c.*, t.treatment_group, t.treatment_label, t.total_amount, t.exposed_count,
         v.v_purchase, v.v_view, v.v_error, v.v_click
  FROM cohort c
  JOIN treatment t ON t.stay_id = c.stay_id
  LEFT JOIN covs v ON v.stay_id = c.stay_id
  WHERE t.treatment_group IS NOT NULL
)
"""


def with_mart(body: str) -> str:
    return "WITH " + MART_CTES.strip() + "\n" + body


def with_mart_and(extra_ctes: str, body: str) -> str:
    return "WITH " + MART_CTES.strip() + ",\n" + extra_ctes.strip() + "\n" + body


def union_per_column(template: str, cols=CONTINUOUS) -> str:
    """``template`` with ``{c}`` replaced per column, joined by UNION ALL."""
    return "\nUNION ALL\n".join(template.format(c=c) for c in cols)
