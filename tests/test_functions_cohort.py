import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.functions import exprs as X
from cohortkit.operators import cohort as K


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_boundary_diff(spark):
    rows = [(ts("2024-01-01 00:59:00"), ts("2024-01-01 04:01:00")), (ts("2024-01-01 23:59:00"), ts("2024-01-02 00:01:00")), (ts("2024-01-01 10:00:00"), ts("2024-01-01 14:00:00"))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    out = df.select(X.boundary_diff("hour", "a", "b").alias("h"), X.boundary_diff("day", "a", "b").alias("d"), X.los_days("a", "b").alias("los")).collect()
    assert [r["h"] for r in out] == [4, 1, 4]
    assert [r["d"] for r in out] == [0, 1, 0]
    # a stay of exactly 4 h passes the >= 4/24 rule
    assert out[2]["los"] >= 4.0 / 24.0


def test_flags_codes_arms(spark):
    df = spark.createDataFrame([("A41.9", 10), ("A419", 10), ("A419", 9), ("99591", 9), (None, 10)], "code string, ver int")
    sets = {10: ["A419", "A41.9"], 9: ["99591"]}
    got = [r[0] for r in df.select(X.flag_codes("code", "ver", sets)).collect()]
    assert got == [1, 1, 0, 1, 0]
    norm = [r[0] for r in df.select(X.flag_codes("code", "ver", {10: ["A41.9"]}, normalise=True)).collect()]
    assert norm == [1, 1, 0, 0, 0]
    arms = spark.createDataFrame([(1, 0), (0, 1), (1, 1), (0, 0), (None, None)], "e int, c int")
    g, l_ = X.assign_arm("e", "c")
    assert [tuple(r) for r in arms.select(g, l_).collect()] == [(1, "exposed"), (0, "comparator"), (1, "exposed"), (None, "neither"), (None, "neither")]
    cat = spark.createDataFrame([(221906,), (225158,), (1,)], "item long").select(X.categorize("item", {"vasopressor": [221906], "fluid": [225158]}))
    assert [r[0] for r in cat.collect()] == ["vasopressor", "fluid", "other"]
    age = spark.createDataFrame([(60, "2150-03-01 10:00:00", 2148), (60, "bad", 2148)], "a int, t string, y int").select(X.age_at("a", "t", "y"))
    assert [r[0] for r in age.collect()] == [62, None]
    num = spark.createDataFrame([("1.5",), ("x",), (None,)], "s string").select(X.to_numeric("s"))
    assert [r[0] for r in num.collect()] == [1.5, None, None]
    b = spark.createDataFrame([(0.05,), (0.1,), (0.3,), (None,)], "x double").select(X.band("x", [0.1, 0.2], ["ok", "mid", "high"]))
    assert [r[0] for r in b.collect()] == ["ok", "mid", "high", None]


def test_window_join_edges(spark):
    idx = spark.createDataFrame([(1, 7, ts("2024-01-01 10:00:00"))], "stay_id long, k long, t0 timestamp_ntz")
    ev = spark.createDataFrame(
        [
            (7, 1, ts("2024-01-01 10:00:00")),  # exactly at index -> in
            (7, 2, ts("2024-01-02 09:59:59")),  # just inside
            (7, 3, ts("2024-01-02 10:00:00")),  # exactly index + 24 h -> out
            (7, 4, ts("2024-01-01 09:59:59")),  # before -> out
            (8, 5, ts("2024-01-01 11:00:00")),  # other key
        ],
        "k long, event_id long, ts timestamp_ntz",
    )
    got = sorted(r["event_id"] for r in K.events_in_window(idx, ev, "k", "t0", "ts", 0, 24).collect())
    assert got == [1, 2]
    got_nb = sorted(r["event_id"] for r in K.events_in_window(idx, ev, "k", "t0", "ts", 0, 24, broadcast_rows=None, bucket_hours=5).collect())
    assert got_nb == [1, 2]


@pytest.mark.parametrize("strict", [True, False])
def test_first_event_after_brute_force(spark, strict):
    rng = np.random.default_rng(4)
    base = dt.datetime(2024, 1, 1)
    # one hot key with most rows, times on a coarse grid -> many equal instants
    keys = np.where(rng.random(600) < 0.6, 0, rng.integers(1, 6, 600))
    mins = rng.integers(0, 60 * 24 * 6, 600) // 30 * 30
    ev = [(int(k), int(i), base + dt.timedelta(minutes=int(m))) for i, (k, m) in enumerate(zip(keys, mins))]
    idx_rows = [(int(1000 + j), int(k), base + dt.timedelta(minutes=int(m))) for j, (k, m) in enumerate(zip(rng.integers(0, 6, 200), rng.integers(0, 60 * 24 * 7, 200) // 30 * 30))]
    evdf = spark.createDataFrame(ev, "k long, event_id long, ts timestamp_ntz")
    idx = spark.createDataFrame(idx_rows, "rid long, k long, t0 timestamp_ntz")
    got = {r["rid"]: r["nxt"] for r in K.first_event_after(idx, evdf, "k", "t0", "ts", "nxt", strict=strict, bucket_hours=12).collect()}
    for rid, k, t0 in idx_rows:
        cands = [t for kk, _, t in ev if kk == k and (t > t0 if strict else t >= t0)]
        assert got[rid] == (min(cands) if cands else None)


def test_first_per_and_attrition(spark):
    df = spark.createDataFrame([(1, 10, ts("2024-01-01 10:00:00")), (2, 10, ts("2024-01-01 09:00:00")), (3, 10, ts("2024-01-01 09:00:00")), (4, 11, ts("2024-01-01 09:00:00"))], "sid long, h long, t timestamp_ntz")
    first = sorted(r["sid"] for r in K.first_per(df, "h", ["t"], "sid").collect())
    assert first == [2, 4]
    att = K.attrition(df, [("h is 10", F.col("h") == 10), ("sid > 1", F.col("sid") > 1)]).collect()
    assert [(r["n_remaining"], r["n_removed"]) for r in att] == [(4, 0), (3, 1), (2, 1)]


def test_exposure_and_covariates(spark):
    coh = spark.createDataFrame([(1, 7, ts("2024-01-01 10:00:00")), (2, 8, ts("2024-01-01 10:00:00")), (3, 9, ts("2024-01-01 10:00:00")), (4, 6, ts("2024-01-01 10:00:00"))], "stay_id long, k long, t0 timestamp_ntz")
    ev = spark.createDataFrame(
        [
            (7, 1, ts("2024-01-01 11:00:00"), "vaso", 221906, 1.0, "mg"),
            (7, 2, ts("2024-01-01 12:00:00"), "fluid", 225158, 500.0, "ml"),
            (7, 3, ts("2024-01-01 12:00:00"), "vaso", 221289, 1.0, "mg"),
            (8, 4, ts("2024-01-01 12:00:00"), "fluid", 225158, 250.0, "ml"),
            (8, 5, ts("2024-01-01 13:00:00"), "fluid", 225158, 100.0, "L"),
            (9, 6, ts("2024-01-03 12:00:00"), "vaso", 221906, 1.0, "mg"),
        ],
        "k long, event_id long, ts timestamp_ntz, cat string, item long, amount double, uom string",
    )
    out = {
        r["stay_id"]: r
        for r in K.exposure_flags(coh, ev, "stay_id", "k", "t0", "ts", "cat", "vaso", "fluid", "amount", "item", unit_col="uom", unit_value="ml", labels=("vasopressor", "fluid_only", "neither")).collect()
    }
    assert (out[1]["treatment_group"], out[1]["treatment_label"], out[1]["exposed_count"], out[1]["total_amount"]) == (1, "vasopressor", 2, 500.0)
    assert (out[2]["treatment_group"], out[2]["total_amount"]) == (0, 250.0)
    assert (out[3]["treatment_group"], out[3]["treatment_label"], out[3]["total_amount"]) == (None, "neither", 0.0)
    assert out[4]["received_exposed"] == 0
    labs = spark.createDataFrame(
        [
            (7, 1, ts("2024-01-01 10:30:00"), 51006, None),  # null first reading skipped
            (7, 2, ts("2024-01-01 10:40:00"), 51006, 0.0),  # zero skipped
            (7, 3, ts("2024-01-01 10:50:00"), 51006, 12.0),
            (7, 5, ts("2024-01-01 11:00:00"), 50912, 2.0),  # tie on time: lower id wins
            (7, 4, ts("2024-01-01 11:00:00"), 50912, 1.5),
            (7, 6, ts("2024-01-01 16:00:00"), 50813, 3.0),  # outside 6 h
        ],
        "k long, lab_id long, ts timestamp_ntz, itemid long, valuenum double",
    )
    cov = {r["stay_id"]: r for r in K.baseline_covariates(coh, labs, "stay_id", "k", "t0", "ts", "itemid", "valuenum", {"bun": 51006, "creatinine": 50912, "lactate": 50813}, "lab_id", 0, 6).collect()}
    assert (cov[1]["bun"], cov[1]["creatinine"], cov[1]["lactate"]) == (12.0, 1.5, None)


def test_outcome(spark):
    df = spark.createDataFrame(
        [(ts("2024-01-01 10:00:00"), ts("2024-01-29 09:00:00"), ts("2024-02-10 00:00:00")), (ts("2024-01-01 10:00:00"), ts("2024-01-30 09:00:00"), None), (ts("2024-01-01 10:00:00"), None, ts("2024-01-05 00:00:00")), (ts("2024-01-05 10:00:00"), ts("2024-01-01 00:00:00"), None)],
        "t0 timestamp_ntz, death timestamp_ntz, out timestamp_ntz",
    )
    r = K.add_outcome(df, "t0", "death", "out", 28).collect()
    assert [(x["outcome_mortality_28d"], x["time_to_event_days"], x["event_observed"]) for x in r] == [(1, 28, 1), (0, 29, 1), (0, 4, 0), (1, -4, 1)]


def test_boundaries_ignore_session_zone(spark):
    rows = [(ts("2024-03-10 01:59:00"), ts("2024-03-10 03:01:00")), (ts("2024-01-01 00:59:00"), ts("2024-01-01 04:01:00"))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    expr = [X.boundary_diff("hour", "a", "b").alias("h"), X.wall_micros("a").alias("m")]
    base = [tuple(r) for r in df.select(*expr).collect()]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [tuple(r) for r in df.select(*expr).collect()] == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [h for h, _ in base] == [2, 4]


def test_first_events_after_multi(spark):
    rng = np.random.default_rng(8)
    base = dt.datetime(2024, 1, 1)
    ev = [(int(k), int(i), base + dt.timedelta(minutes=int(m)), ["a", "b", "c"][int(c)]) for i, (k, m, c) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 60 * 24 * 4, 400) // 20 * 20, rng.integers(0, 3, 400)))]
    idx_rows = [(int(1000 + j), int(k), base + dt.timedelta(minutes=int(m))) for j, (k, m) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 60 * 24 * 4, 80) // 20 * 20))]
    evdf = spark.createDataFrame(ev, "k long, event_id long, ts timestamp_ntz, typ string")
    idx = spark.createDataFrame(idx_rows, "rid long, k long, t0 timestamp_ntz")
    res = K.first_events_after(idx, evdf, "k", "t0", "ts", {"any": None, "only_b": F.col("typ") == "b"}, strict=True, bucket_hours=6)
    got = {r["rid"]: (r["any"], r["only_b"]) for r in res.collect()}
    res2 = K.first_events_after(idx, evdf, "k", "t0", "ts", {"any": None, "only_b": F.col("typ") == "b"}, strict=True, bucket_hours=6, broadcast_rows=None)
    assert {r["rid"]: (r["any"], r["only_b"]) for r in res2.collect()} == got
    for rid, k, t0 in idx_rows:
        a = [t for kk, _, t, _ in ev if kk == k and t > t0]
        b = [t for kk, _, t, typ in ev if kk == k and t > t0 and typ == "b"]
        assert got[rid] == (min(a) if a else None, min(b) if b else None)


def test_window_join_hot_key_shuffle_path(spark):
    """A key holding most rows, joined without broadcast (shuffle on key and
    time bucket), equals the brute-force window relation."""
    rng = np.random.default_rng(12)
    base = dt.datetime(2024, 1, 1)
    keys = np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 20, 3000))
    ev = [(int(k), int(i), base + dt.timedelta(minutes=int(m))) for i, (k, m) in enumerate(zip(keys, rng.integers(0, 60 * 24 * 20, 3000)))]
    idx_rows = [(int(10_000 + j), int(k), base + dt.timedelta(minutes=int(m))) for j, (k, m) in enumerate(zip(np.where(rng.random(300) < 0.7, 0, rng.integers(1, 20, 300)), rng.integers(0, 60 * 24 * 20, 300)))]
    evdf = spark.createDataFrame(ev, "k long, event_id long, ts timestamp_ntz")
    idx = spark.createDataFrame(idx_rows, "rid long, k long, t0 timestamp_ntz")
    got = sorted((r["rid"], r["event_id"]) for r in K.events_in_window(idx, evdf, "k", "t0", "ts", 2, 30, broadcast_rows=None).collect())
    exp = sorted((rid, eid) for rid, k, t0 in idx_rows for kk, eid, t in ev if kk == k and t0 + dt.timedelta(hours=2) <= t < t0 + dt.timedelta(hours=30))
    assert got == exp


def test_administrative_censor(spark):
    df = spark.createDataFrame([(10, 1), (40, 1), (40, 0), (28, 1)], "d int, e int")
    out = [tuple(r) for r in K.administrative_censor(df, "d", "e", 28).collect()]
    assert out == [(10, 1), (28, 0), (28, 0), (28, 1)]


def test_first_per_nulls_last(spark):
    df = spark.createDataFrame([(1, 10, None), (2, 10, ts("2024-01-01 09:00:00")), (3, 11, None)], "sid long, h long, t timestamp_ntz")
    assert sorted(r["sid"] for r in K.first_per(df, "h", ["t"], "sid").collect()) == [2, 3]


def test_lookback_window(spark):
    """Window before the index: [index - 48 h, index - 1 h)."""
    rng = np.random.default_rng(23)
    base = dt.datetime(2024, 1, 1)
    ev = [(int(k), int(i), base + dt.timedelta(minutes=int(m))) for i, (k, m) in enumerate(zip(rng.integers(0, 4, 800), rng.integers(0, 60 * 24 * 10, 800)))]
    idx_rows = [(int(100 + j), int(k), base + dt.timedelta(minutes=int(m))) for j, (k, m) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 60 * 24 * 10, 60)))]
    evdf = spark.createDataFrame(ev, "k long, event_id long, ts timestamp_ntz")
    idx = spark.createDataFrame(idx_rows, "rid long, k long, t0 timestamp_ntz")
    got = sorted((r["rid"], r["event_id"]) for r in K.events_in_window(idx, evdf, "k", "t0", "ts", -48, -1).collect())
    exp = sorted((rid, eid) for rid, k, t0 in idx_rows for kk, eid, t in ev if kk == k and t0 - dt.timedelta(hours=48) <= t < t0 - dt.timedelta(hours=1))
    assert got == exp


def test_pivot_first_packed_and_struct_orders(spark):
    rows = [(1, "a", 5.0, ts("2024-01-01 10:00:00"), 3), (1, "a", 6.0, ts("2024-01-01 10:00:00"), 2), (1, "b", 7.0, ts("2024-01-01 09:00:00"), 9), (2, "a", 1.0, ts("2024-01-02 00:00:00"), 1)]
    df = spark.createDataFrame(rows, "k long, item string, v double, t timestamp_ntz, id long")
    packed = {r["k"]: (r["A"], r["B"]) for r in K.pivot_first(df, "k", "item", "v", ["t", "id"], {"A": "a", "B": "b"}).collect()}
    struct = {r["k"]: (r["A"], r["B"]) for r in K.pivot_first(df, "k", "item", "v", ["t", "id", "v"], {"A": "a", "B": "b"}).collect()}
    assert packed == struct == {1: (6.0, 7.0), 2: (1.0, None)}


def test_first_event_after_null_index_time(spark):
    ev = spark.createDataFrame([(1, 10, ts("2024-01-02 00:00:00"))], "k long, event_id long, ts timestamp_ntz")
    idx = spark.createDataFrame([(1, 1, None), (2, 1, ts("2024-01-01 00:00:00"))], "rid long, k long, t0 timestamp_ntz")
    got = {r["rid"]: r["nxt"] for r in K.first_event_after(idx, ev, "k", "t0", "ts", "nxt").collect()}
    assert got == {1: None, 2: ts("2024-01-02 00:00:00")}


@pytest.mark.parametrize("max_bytes", [0, 64_000_000])
def test_codes_and_categories_from_tables(spark, max_bytes):
    from cohortkit.operators import cohort as K

    df = spark.createDataFrame([(1, "995.92", 9), (2, "99592", 9), (3, "A41.9", 10), (4, "A419", 9), (5, None, 9), (6, "x", None)], "id int, code string, __hit int")
    codes = spark.createDataFrame([(9, "99592"), (9, "995.92"), (10, "A419"), (None, "x"), (9, None)], "version int, code string")
    got = {r["id"]: r["f"] for r in K.flag_by_table(df, "code", "__hit", codes, "f", normalise=True, max_bytes=max_bytes).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    assert {r["id"]: r["f"] for r in K.flag_by_table(df, "code", "__hit", codes, "f", max_bytes=max_bytes).collect()}[3] == 0
    mapping = spark.createDataFrame([("99592", "b", 2), ("995.92", "a", 1), ("A41.9", "z", 1), ("A419", "y", 1), (None, "n", 0)], "key string, category string, rank int")
    got = {r["id"]: r["c"] for r in K.categorize_by_table(df, "code", mapping, "c", normalise=True, max_bytes=max_bytes).collect()}
    assert got == {1: "a", 2: "a", 3: "y", 4: "y", 5: "other", 6: "other"}


def test_correlations_of_many_columns(spark, monkeypatch):
    from cohortkit.operators import gram

    monkeypatch.setattr(gram, "FAN_IN", 2)
    rng = np.random.default_rng(0)
    p, n = 60, 400
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + 1e6
    x[:, 7] = 3.5
    x[rng.random((n, p)) < 0.2] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"`c.{j}` double" for j in range(p))).repartition(7)
    got = gram.correlation_matrix(df, [f"c.{j}" for j in range(p)])
    for i, j in [(0, 1), (3, 50), (12, 40), (59, 58), (20, 20)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert abs(got[i, j] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    assert np.isnan(got[7]).all()
