import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import cox as C
from cohortkit.operators import survival as S


def _df(spark, t, e, X=None, names=None):
    names = names or [f"x{j}" for j in range(0 if X is None else X.shape[1])]
    rows = []
    for i in range(len(t)):
        rows.append(tuple([float(t[i]), int(e[i])] + ([] if X is None else [float(v) for v in X[i]])))
    schema = "t double, e int" + "".join(f", {n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def brute_cindex(t, e, r):
    num = den = 0.0
    for i in range(len(t)):
        if e[i] != 1:
            continue
        for j in range(len(t)):
            if t[j] > t[i] or (t[j] == t[i] and e[j] == 0):
                den += 1
                num += 1.0 if r[j] < r[i] else (0.5 if r[j] == r[i] else 0.0)
    return num / den, den


@pytest.mark.parametrize("seed", [0, 1])
def test_concordance_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    t = rng.integers(0, 12, n).astype(float)
    e = (rng.random(n) < 0.6).astype(int)
    r = np.round(rng.normal(size=n), 1)  # many ties in risk
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r)], "t double, e int, r double")
    row = S.concordance(df, "t", "e", "r").first()
    c, den = brute_cindex(t, e, r)
    assert row["n_comparable"] == den
    assert abs(row["c_index"] - c) < 1e-12


def test_auc_brute_force(spark):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 20, 200).astype(float)
    y = (rng.random(200) < 0.4).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    auc = S.roc_auc(df, "s", "y").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    exp = np.mean([(1.0 if p > q else 0.5 if p == q else 0.0) for p in pos for q in neg])
    assert abs(auc - exp) < 1e-12


def test_km_edges(spark):
    # all events on one day; last unit dies -> S = 0; tie of event and censoring
    t = [1, 1, 2, 2, 3, 5]
    e = [1, 0, 1, 1, 0, 1]
    df = spark.createDataFrame([(int(a), int(b), "g") for a, b in zip(t, e)], "t int, e int, g string")
    km = {r["time"]: r for r in S.kaplan_meier(df, "t", "e", "g").collect()}
    s = 1.0
    n = 6
    for time in [1, 2, 3, 5]:
        d = sum(1 for a, b in zip(t, e) if a == time and b == 1)
        c = sum(1 for a in t if a == time)
        s *= 1 - d / n
        assert km[time]["n_at_risk"] == n
        assert abs(km[time]["survival"] - s) < 1e-12
        n -= c
    assert km[5]["survival"] == 0.0
    at = {r["time_point"]: r["survival"] for r in S.survival_at(S.kaplan_meier(df, "t", "e"), [0.5, 2.5, 10.0]).collect()}
    assert at[0.5] == 1.0 and abs(at[2.5] - (5 / 6) * (2 / 4)) < 1e-12 and at[10.0] == 0.0


def test_logrank_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 200
    t = rng.integers(0, 10, n)
    e = (rng.random(n) < 0.7).astype(int)
    g = (rng.random(n) < 0.5).astype(int)
    df = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(t, e, g)], "t int, e int, g int")
    row = S.logrank(df, "t", "e", "g", 1).first()
    o = ex = v = 0.0
    for time in np.unique(t):
        at = t >= time
        nn, n1 = at.sum(), (at & (g == 1)).sum()
        d = ((t == time) & (e == 1)).sum()
        d1 = ((t == time) & (e == 1) & (g == 1)).sum()
        o += d1
        ex += d * n1 / nn
        if nn > 1:
            v += n1 * (nn - n1) * d * (nn - d) / (nn * nn * (nn - 1))
    chi2 = (o - ex) ** 2 / v
    assert abs(row["chi2"] - chi2) < 1e-9
    assert abs(row["p_value"] - math.erfc(math.sqrt(chi2 / 2))) < 1e-12


def numpy_cox(t, e, X, penalizer):
    """Independent Efron Cox: rows, loops over distinct event times, Newton."""
    m, s = X.mean(0), X.std(0, ddof=1)
    Z = (X - m) / s
    n, p = Z.shape
    b = np.zeros(p)
    for _ in range(100):
        ll, g, H = 0.0, np.zeros(p), np.zeros((p, p))
        w = np.exp(Z @ b)
        for time in np.unique(t[e == 1]):
            risk = t >= time
            dead = (t == time) & (e == 1)
            d = dead.sum()
            r0, r1, r2 = w[risk].sum(), (w[risk, None] * Z[risk]).sum(0), np.einsum("i,ij,ik->jk", w[risk], Z[risk], Z[risk])
            d0, d1, d2 = w[dead].sum(), (w[dead, None] * Z[dead]).sum(0), np.einsum("i,ij,ik->jk", w[dead], Z[dead], Z[dead])
            ll += (Z[dead] @ b).sum()
            g += Z[dead].sum(0)
            for l in range(d):
                f = l / d
                phi, phi1, phi2 = r0 - f * d0, r1 - f * d1, r2 - f * d2
                ll -= math.log(phi)
                g -= phi1 / phi
                H -= phi2 / phi - np.outer(phi1, phi1) / phi**2
        ll -= n * penalizer / 2 * b @ b
        g -= n * penalizer * b
        H -= n * penalizer * np.eye(p)
        step = np.linalg.solve(-H, g)
        b = b + step
        if np.linalg.norm(step) < 1e-10:
            break
    cov = np.linalg.inv(-H) / np.outer(s, s)
    return b / s, np.sqrt(np.diag(cov))


@pytest.mark.parametrize("pen", [0.1, 0.0])
def test_cox_against_numpy(spark, pen):
    rng = np.random.default_rng(11)
    n = 400
    X = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n), rng.normal(3, 2, size=n)])
    risk = np.exp(0.7 * X[:, 0] - 0.3 * X[:, 1])
    t = np.minimum(np.ceil(rng.exponential(5 / risk)), 15)  # whole days, heavy ties
    e = (rng.random(n) < 0.75).astype(int)
    df = _df(spark, t, e, X, ["a", "b", "c"])
    model = C.cox_ph(df, "t", "e", ["a", "b", "c"], penalizer=pen)
    coef, se = numpy_cox(t, e, X, pen)
    assert np.allclose(model.coef, coef, atol=1e-7)
    assert np.allclose(model.se, se, atol=1e-7)
    # risk scores and C-index run on Spark
    scored = df.withColumn("risk", C.predict_risk(model))
    c = S.concordance(scored, "t", "e", "risk").first()["c_index"]
    assert 0.5 < c < 1.0
    ph = C.ph_test(model)
    assert len(ph) == 3 and all(0 <= p <= 1 for _, _, p in ph)


def test_ph_test_against_numpy(spark):
    rng = np.random.default_rng(2)
    n = 150
    X = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n)])
    t = rng.integers(1, 8, n).astype(float)
    e = (rng.random(n) < 0.7).astype(int)
    model = C.cox_ph(_df(spark, t, e, X, ["a", "b"]), "t", "e", ["a", "b"], penalizer=0.1)
    # rowwise scaled Schoenfeld residuals with Efron weighted means
    beta = model.coef
    Xc = X - X.mean(0)
    w = np.exp(Xc @ beta)
    resid, times = [], []
    for time in np.unique(t[e == 1]):
        risk = t >= time
        dead = (t == time) & (e == 1)
        d = dead.sum()
        mean = np.zeros(2)
        for l in range(d):
            f = l / d
            num = (w[risk, None] * Xc[risk]).sum(0) - f * (w[dead, None] * Xc[dead]).sum(0)
            den = w[risk].sum() - f * w[dead].sum()
            mean += num / den / d
        for i in np.nonzero(dead)[0]:
            resid.append(Xc[i] - mean)
            times.append(t[i])
    resid = np.array(resid)
    scaled = e.sum() * resid @ model.variance
    order = np.argsort(t, kind="mergesort")
    ranks = np.empty(n)
    # average ranks of all durations
    vals, inv, counts = np.unique(t, return_inverse=True, return_counts=True)
    cum = np.cumsum(counts) - counts
    avg = cum + (counts + 1) / 2
    g = np.array([avg[np.searchsorted(vals, tt)] for tt in times])
    gd = g - g.mean()
    T = (gd[:, None] * scaled).sum(0) ** 2 / (e.sum() * np.diag(model.variance) * (gd**2).sum())
    got = np.array([s for _, s, _ in C.ph_test(model)])
    assert np.allclose(got, T, rtol=1e-7, atol=1e-10)


def test_cox_with_all_durations_distinct_and_many_blocks(spark):
    rng = np.random.default_rng(4)
    n = 600
    X = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n)])
    t = rng.exponential(5 / np.exp(0.5 * X[:, 0] - 0.4 * X[:, 1]))
    e = (rng.random(n) < 0.7).astype(int)
    assert len(np.unique(t)) == n
    model = C.cox_ph(_df(spark, t, e, X, ["a", "b"]), "t", "e", ["a", "b"], rows_per_block=37)
    assert model.order.rows.rdd.getNumPartitions() > 10
    coef, se = numpy_cox(t, e, X, 0.1)
    assert np.allclose(model.coef, coef, atol=1e-7) and np.allclose(model.se, se, atol=1e-7)
    assert (model.n, model.n_events) == (n, e.sum())


@pytest.mark.parametrize("rows_per_block", [5, 50_000])
def test_a_time_with_a_third_of_all_units_stands_in_many_blocks(spark, rows_per_block):
    rng = np.random.default_rng(5)
    n = 300
    X = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n)])
    t = np.where(rng.random(n) < 0.4, 28.0, rng.integers(1, 40, n).astype(float))
    e = (rng.random(n) < 0.6).astype(int)
    X = np.vstack([X, X[:20]])  # repeated rows
    t, e = np.concatenate([t, t[:20]]), np.concatenate([e, e[:20]])
    df = _df(spark, t, e, X, ["a", "b"])
    model = C.cox_ph(df, "t", "e", ["a", "b"], rows_per_block=rows_per_block)
    coef, se = numpy_cox(t, e, X, 0.1)
    assert np.allclose(model.coef, coef, atol=1e-7) and np.allclose(model.se, se, atol=1e-7)
    whole = C.cox_ph(df, "t", "e", ["a", "b"])
    for (c, x, p), (c2, x2, p2) in zip(C.ph_test(model), C.ph_test(whole), strict=True):
        assert c == c2 and x == pytest.approx(x2, rel=1e-8) and p == pytest.approx(p2, rel=1e-8)
    residuals = C.schoenfeld_residuals(model).toPandas()
    assert residuals["n"].sum() == e.sum()
    # unpenalised score equations do not hold under a penalty, but ranks must be the averages over all units
    for t0 in (28.0, 7.0):
        got = residuals.loc[residuals["duration"] == t0, "time_rank"].unique()
        assert len(got) <= 1 and all(got == (t < t0).sum() + ((t == t0).sum() + 1) / 2)


def test_terms_at_given_coefficients(spark):
    rng = np.random.default_rng(6)
    n = 80
    X = rng.normal(size=(n, 2))
    t, e = rng.integers(1, 9, n).astype(float), (rng.random(n) < 0.6).astype(int)
    beta, ll, grad = np.array([0.3, -0.2]), 0.0, np.zeros(2)
    w = np.exp(X @ beta)
    for time in np.unique(t[e == 1]):
        risk, dead = t >= time, (t == time) & (e == 1)
        d = dead.sum()
        ll += (X[dead] @ beta).sum()
        grad += X[dead].sum(0)
        for k in range(d):
            phi = w[risk].sum() - k / d * w[dead].sum()
            ll -= math.log(phi)
            grad -= ((w[risk, None] * X[risk]).sum(0) - k / d * (w[dead, None] * X[dead]).sum(0)) / phi
    model, score = C.cox_at(_df(spark, t, e, X, ["a", "b"]), "t", "e", ["a", "b"], beta, rows_per_block=9)
    assert (model.n, model.n_events) == (n, e.sum())
    # covariates are centred, which moves the likelihood by nothing
    assert model.loglik == pytest.approx(ll, rel=1e-9)
    assert score.tolist() == pytest.approx(grad.tolist(), abs=1e-8)


def test_screening(spark):
    rows = []
    for i in range(40):
        rows.append((float(i % 7), 5.0, None if i % 2 == 0 or i % 3 == 0 else float(i), float(i), 2.0 * i + 1.0, float(i % 5) if i != 3 else None, 1))
    df = spark.createDataFrame(rows, "t double, const double, sparse double, a double, a2 double, b double, e int")
    out, kept, dropped = C.screen_covariates(df, ["const", "sparse", "a", "a2", "b"], "t", "e")
    reasons = dict(dropped)
    assert reasons == {"const": "constant", "sparse": "missing", "a2": "collinear"}
    assert kept == ["a", "b"]
    assert out.where(F.col("b").isNull()).count() == 0


def test_km_ci_against_greenwood(spark):
    rng = np.random.default_rng(9)
    t = rng.integers(0, 8, 120)
    e = (rng.random(120) < 0.5).astype(int)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, e)], "t int, e int")
    rows = {r["time"]: r for r in S.kaplan_meier(df, "t", "e").collect()}
    s, v, n = 1.0, 0.0, len(t)
    for time in sorted(set(t)):
        d = int(((t == time) & (e == 1)).sum())
        s *= 1 - d / n
        if n > d:
            v += d / (n * (n - d))
        r = rows[time]
        if 0 < s < 1:
            lv = math.log(s)
            lo = math.exp(-math.exp(math.log(-lv) - S.Z95 * math.sqrt(v) / lv))
            hi = math.exp(-math.exp(math.log(-lv) + S.Z95 * math.sqrt(v) / lv))
            assert abs(r["ci_lower"] - lo) < 1e-12 and abs(r["ci_upper"] - hi) < 1e-12
            assert r["ci_lower"] <= r["survival"] <= r["ci_upper"]
        n -= int((t == time).sum())


def test_km_over_many_blocks_and_a_null_group(spark, monkeypatch):
    from cohortkit.operators import running

    rng = np.random.default_rng(21)
    n = 300
    t, e = np.round(rng.exponential(5, n), 3), (rng.random(n) < 0.6).astype(int)  # continuous durations
    g = [None if k % 3 == 0 else "ab"[k % 2] for k in range(n)]
    df = spark.createDataFrame([(float(a), int(b), c, int(c == "a")) for a, b, c in zip(t, e, g)], "t double, e int, g string, gi int")
    read = lambda: (sorted(map(tuple, S.kaplan_meier(df, "t", "e", "g").collect()), key=str), S.logrank_stats(df, "t", "e", "gi").first()["chi2"], S.concordance(df, "t", "e", "t").first())
    one = read()
    whole = running.running_sums
    monkeypatch.setattr(S, "running_sums", lambda *a, **k: whole(*a, **k, rows_per_block=40))
    many = read()
    assert len(one[0]) == len(many[0]) and {r[0] for r in one[0]} == {None, "a", "b"}
    for a, b in zip(one[0], many[0]):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], atol=1e-9)
    assert abs(one[1] - many[1]) < 1e-9 and one[2] == many[2]


def test_concordance_of_two_valued_risk(spark):
    rows = [(float(k % 7), int(k % 3 > 0), float(k % 2)) for k in range(200)]
    row = S.concordance(spark.createDataFrame(rows, "t double, e int, r double"), "t", "e", "r").first()
    t, e, r = (np.array(x) for x in zip(*rows))
    c, den = brute_cindex(t, e, r)
    assert row["n_comparable"] == den and abs(row["c_index"] - c) < 1e-12
