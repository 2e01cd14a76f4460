import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators.matching import greedy_match, match_nearest


def plain_greedy(t_ids, t_x, c_ids, c_x, cal):
    """Textbook loop: treated by (score, id); nearest free control, ties -> lowest id."""
    order = sorted(range(len(t_ids)), key=lambda i: (t_x[i], t_ids[i]))
    used = set()
    out = []
    for i in order:
        best = None
        for j in range(len(c_ids)):
            if c_ids[j] in used:
                continue
            d = abs(c_x[j] - t_x[i])
            key = (d, c_ids[j])
            if best is None or key < best[0]:
                best = (key, j)
        if best is None:
            break
        (d, cid), j = best
        if d <= cal:
            used.add(cid)
            out.append((int(t_ids[i]), int(cid)))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_kernel_equals_plain_greedy(seed):
    rng = np.random.default_rng(seed)
    nt, nc = rng.integers(1, 60), rng.integers(1, 60)
    # coarse grid values force equal scores and equal distances
    t_x = rng.integers(0, 25, nt) / 4.0
    c_x = rng.integers(0, 25, nc) / 4.0
    t_ids = rng.permutation(1000)[:nt]
    c_ids = rng.permutation(1000)[:nc] + 2000
    cal = float(rng.choice([0.25, 0.5, 1.0, 0.0]))
    got = [(a, b) for a, b, _ in greedy_match(t_ids, t_x, c_ids, c_x, cal)]
    assert got == plain_greedy(t_ids, t_x, c_ids, c_x, cal)


def test_edge_cases():
    # equidistant controls on both sides -> lowest id; distance exactly the caliper matches
    assert [(a, b) for a, b, _ in greedy_match(np.array([1]), np.array([1.0]), np.array([9, 5]), np.array([0.5, 1.5]), 0.5)] == [(1, 5)]
    # no control within caliper
    assert greedy_match(np.array([1]), np.array([0.0]), np.array([2]), np.array([1.0]), 0.5) == []
    # more treated than controls
    assert len(greedy_match(np.array([1, 2, 3]), np.array([0.0, 0.1, 0.2]), np.array([7]), np.array([0.1]), 1.0)) == 1


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_spark_chunks_equal_sequential(spark, seed):
    rng = np.random.default_rng(100 + seed)
    n = 3000
    x = np.round(rng.normal(size=n), 2)  # rounding creates ties
    t = (rng.random(n) < 0.45).astype(int)
    ids = rng.permutation(n) + 1
    rows = [(int(i), int(a), float(b)) for i, a, b in zip(ids, t, x)]
    df = spark.createDataFrame(rows, "uid long, treat int, x double")
    cal = 0.2 * float(np.std(x, ddof=1))
    pairs = match_nearest(df, "uid", "treat", "x", cal, rows_per_chunk=200)
    got = sorted((r["match_id"], r["treated_id"], r["control_id"]) for r in pairs.collect())
    exp = plain_greedy(ids[t == 1], x[t == 1], ids[t == 0], x[t == 0], cal)
    assert [(a, b) for _, a, b in got] == exp
    assert [m for m, _, _ in got] == list(range(len(exp)))


def test_chain_across_seams(spark):
    # a dense run of alternating units: every greedy choice depends on the previous one
    n = 400
    x = np.arange(n) * 0.01
    t = np.arange(n) % 2
    ids = np.arange(n) + 1
    df = spark.createDataFrame([(int(i), int(a), float(b)) for i, a, b in zip(ids, t, x)], "uid long, treat int, x double")
    pairs = match_nearest(df, "uid", "treat", "x", 0.015, rows_per_chunk=20)
    got = sorted((r["treated_id"], r["control_id"]) for r in pairs.collect())
    exp = sorted(plain_greedy(ids[t == 1], x[t == 1], ids[t == 0], x[t == 0], 0.015))
    assert got == exp


def spark_pairs(spark, ids, t, x, cal, rows_per_chunk, **options):
    df = spark.createDataFrame([(int(i), int(a), float(b)) for i, a, b in zip(ids, t, x)], "uid long, treat int, x double")
    return sorted((r["match_id"], r["treated_id"], r["control_id"]) for r in match_nearest(df, "uid", "treat", "x", cal, rows_per_chunk=rows_per_chunk, **options).collect())


@pytest.mark.parametrize(("share", "cal", "seed"), [(0.5, 0.5, 0), (0.25, 3.0, 1), (0.7, 0.3, 2), (0.5, 100.0, 3)])
def test_a_score_shared_by_a_third_of_all_units(spark, share, cal, seed):
    rng = np.random.default_rng(seed)
    n = 900
    x = np.where(rng.random(n) < 0.35, 4.0, np.round(rng.normal(4, 2, n), 1))
    t = (rng.random(n) < share).astype(int)
    ids = rng.permutation(n) + 1
    got = spark_pairs(spark, ids, t, x, cal, 40)
    exp = plain_greedy(ids[t == 1], x[t == 1], ids[t == 0], x[t == 0], cal)
    assert [(a, b) for _, a, b in got] == exp and [m for m, _, _ in got] == list(range(len(exp)))


def test_no_chunk_exceeds_its_bound(spark, monkeypatch):
    from cohortkit.operators import score_line

    rng = np.random.default_rng(7)
    x = np.where(rng.random(3000) < 0.4, 1.0, np.where(rng.random(3000) < 0.5, rng.normal(1, 0.01, 3000), np.round(rng.normal(size=3000), 1)))
    units = spark.createDataFrame([("", int(i), int(rng.random() < 0.6), float(v)) for i, v in enumerate(x)], "stratum string, uid long, kind int, x double")
    sizes = score_line.chunked(units, 100).groupBy("chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 300 and len(sizes) > 10


def test_chunks_widen_with_the_table():
    from cohortkit.operators.score_line import CHUNKS, WIDEST, chunk_rows

    assert chunk_rows(500, 60) == 60  # small tables keep the size asked for
    assert chunk_rows(1_000, 200_000) == 200_000
    for n in (10_000, 300_000, 3_000_000):
        assert 60 < chunk_rows(n, 60) <= WIDEST and n / chunk_rows(n, 60) <= CHUNKS
    assert chunk_rows(10**9, 60) == WIDEST  # and no task grows without bound


def test_rounds_do_not_grow_with_the_table(spark, monkeypatch):
    # more treated than controls: each chunk depends on all within a caliper before it
    from cohortkit.operators import score_line

    rounds = []
    inputs = score_line._Line.inputs
    monkeypatch.setattr(score_line._Line, "inputs", lambda self: rounds.append(len(self.chunks)) or inputs(self))
    rng = np.random.default_rng(11)
    n = 4000
    x, t, ids = np.round(rng.random(n) * 10_000, 1), (rng.random(n) < 0.6).astype(int), rng.permutation(n) + 1
    got = spark_pairs(spark, ids, t, x, 150.0, 10)
    assert [(a, b) for _, a, b in got] == plain_greedy(ids[t == 1], x[t == 1], ids[t == 0], x[t == 0], 150.0)
    assert rounds[0] <= 2 * score_line.CHUNKS and len(rounds) <= 12


@pytest.mark.parametrize("rows_per_chunk", [10, 60, 100_000])
def test_exact_on_matches_inside_strata(spark, rows_per_chunk):
    rng = np.random.default_rng(8)
    n = 500
    x, t = np.round(rng.normal(size=n), 1), (rng.random(n) < 0.5).astype(int)
    site = rng.choice(["a", "b", "c", "d", None], n, p=[0.5, 0.3, 0.1, 0.05, 0.05])
    ids = rng.permutation(n) + 1
    df = spark.createDataFrame([(int(i), int(a), float(b), s, 1) for i, a, b, s in zip(ids, t, x, site)], "uid long, treat int, x double, site string, k int")
    rows = match_nearest(df, "uid", "treat", "x", 0.2, rows_per_chunk=rows_per_chunk, exact_on=["site", "k"]).collect()
    want = set()
    for s in ["a", "b", "c", "d", None]:
        at = np.array([v == s for v in site])
        want |= set(plain_greedy(ids[at & (t == 1)], x[at & (t == 1)], ids[at & (t == 0)], x[at & (t == 0)], 0.2))
    assert {(r["treated_id"], r["control_id"]) for r in rows} == want
    assert sorted(r["match_id"] for r in rows) == list(range(len(want)))


def test_no_units_and_units_of_one_kind(spark):
    assert spark_pairs(spark, [], [], [], 1.0, 10) == []
    assert spark_pairs(spark, [1, 2], [1, 1], [0.0, 0.1], 1.0, 10) == []
    assert spark_pairs(spark, [1, 2], [0, 0], [0.0, 0.1], 1.0, 10) == []


@pytest.mark.parametrize("seed", range(40))
def test_walk_in_pieces_equals_the_plain_loop(seed):
    """Chunks replayed one after another, each on what it should see: no Spark needed."""
    from cohortkit.operators.score_line import _Line, walk

    rng = np.random.default_rng(seed)
    n, size = int(rng.integers(5, 120)), int(rng.integers(2, 12))
    x, kind = rng.integers(0, 12, n) / 4.0, (rng.random(n) < rng.choice([0.3, 0.5, 0.7])).astype(int)
    cal = float(rng.choice([0.25, 0.5, 2.0]))
    units = sorted((x[i], kind[i], int(u)) for i, u in enumerate(rng.permutation(n)))
    chunks, where = {}, {}
    for pos, (s, k, u) in enumerate(units):
        run = [p for p, v in enumerate(units) if v[0] == s and v[1] == 1]
        crowded = k == 1 and len(run) > size
        place = run[0] if k == 1 and not crowded else pos
        c = (run[0] + (pos - run[0]) // size * size) * 2 + 1 if crowded else place // size * size * 2
        chunks.setdefault(c, []).append((s, k, u))
        where.setdefault(c, pos)
    order = sorted(chunks, key=where.get)
    table = [{"chunk": c, "n_t": sum(k == 0 for _, k, _ in chunks[c]), "n_c": sum(k == 1 for _, k, _ in chunks[c]), "line": "",
              "t_lo": min((s for s, k, _ in chunks[c] if k == 0), default=None), "c_hi": max((s for s, k, _ in chunks[c] if k == 1), default=None)} for c in order]
    line, seen, pairs = _Line(table, cal), {}, {}
    own = {c: sorted((s, u) for s, k, u in chunks[c] if k == 1) for c in order}
    rest = {c: sorted(own[c], key=lambda v: (-v[0], v[1])) for c in order}
    for _ in range(len(order) + 2):
        wanted = line.inputs()
        todo = [c for c in order if seen.get(c) != wanted[c]]
        if not todo:
            break
        new = {}
        for c in todo:
            used, left, right = wanted[c]
            stack = [v for of, lo, hi, _ in left for v in rest[of][lo:hi]]
            queue = [v for of, lo, hi in right for v in own[of][lo:hi]]
            new[c] = walk(sorted((s, u) for s, k, u in chunks[c] if k == 0), own[c], used, stack, queue, cal)
            seen[c] = wanted[c]
        for c, (found, popped, beyond, left_over) in new.items():
            pairs[c], rest[c] = found, left_over
            line.out[c] = (popped, beyond, len(left_over), hash(tuple(left_over)))
    else:
        raise AssertionError("no fixed point")
    got = [(t, c) for k in order for t, c, _ in pairs[k]]
    side = lambda k, i: np.array([v[i] for v in units if v[1] == k])
    assert got == plain_greedy(side(0, 2), side(0, 0), side(1, 2), side(1, 0), cal)


def test_propensity_matches_newton_solution(spark):
    """Spark ML fit == NumPy Newton solve of C*sum(logloss) + ||w||^2/2
    (intercept unpenalised) on population-SD standardised features."""
    from cohortkit.operators.matching import propensity_score

    rng = np.random.default_rng(13)
    n = 400
    X = np.column_stack([rng.normal(50, 10, n), rng.exponential(2, n), rng.integers(0, 2, n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.05 * (X[:, 0] - 50) + 0.4 * X[:, 2] - 0.3)))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), float(c), int(t)) for i, (a, b, c), t in zip(range(n), X, y)], "id long, a double, b double, c double, t int")
    got = {r["id"]: r["propensity_score"] for r in propensity_score(df, ["a", "b", "c"], "t").collect()}
    Z = (X - X.mean(0)) / X.std(0)
    A = np.column_stack([np.ones(n), Z])
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ w))
        g = A.T @ (p - y) + np.r_[0, w[1:]]  # C = 1
        H = A.T @ (A * (p * (1 - p))[:, None]) + np.diag([0, 1, 1, 1])
        step = np.linalg.solve(H, g)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    exp = 1 / (1 + np.exp(-A @ w))
    assert max(abs(got[i] - exp[i]) for i in range(n)) < 1e-6
