"""Plan-shape guards for the scale properties the operators rely on."""

import contextlib
import io

from pyspark.sql import functions as F

from cohortkit.operators import cohort as K
from cohortkit.plans import study

from .conftest import SF01


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_window_join_broadcasts_index_and_prunes_scan(spark):
    coh = study.shared_cohort(spark, SF01).select("stay_id", "subject_id", "index_date")
    ev = study.events(spark, SF01).select("subject_id", "event_id", "ts", "value")
    p = plan(K.events_in_window(coh, ev, "subject_id", "index_date", "ts", 0, 24))
    assert "BroadcastHashJoin" in p
    assert "GreaterThanOrEqual(ts," in p and "LessThan(ts," in p  # range filter reaches the parquet scan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in p  # column pruning


def test_first_per_group_limits_before_shuffle(spark):
    li = study.load(spark, SF01, "lineitem")
    p = plan(K.first_per(li, "l_orderkey", ["l_shipdate"], "l_linenumber"))
    before_exchange = p.split("Exchange", 1)[1]
    assert "WindowGroupLimit" in before_exchange  # partial limit on the map side


def test_exposure_flags_aggregate_partially(spark):
    p = plan(study.treatment(spark, SF01, study.shared_cohort(spark, SF01)))
    assert "partial_max" in p and "partial_sum" in p and "partial_min" in p
    assert "BroadcastHashJoin" in p
