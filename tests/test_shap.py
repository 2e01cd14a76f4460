import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortkit.operators import interpret as G


def _tree_nodes(spark, model):
    from cohortkit.session import scratch_path

    path = scratch_path(spark, "probe")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return trees


def _value(tree, x, S):
    """Path-dependent expectation: follow x on features in S, else cover-weighted."""

    def rec(nid):
        nd = tree[nid]
        if nd["leftChild"] < 0:
            return nd["prediction"]
        f = nd["split"]["featureIndex"]
        thr = nd["split"]["leftCategoriesOrThreshold"][0]
        if f in S:
            return rec(nd["leftChild"] if x[f] <= thr else nd["rightChild"])
        l, r = tree[nd["leftChild"]], tree[nd["rightChild"]]
        return (l["rawCount"] * rec(nd["leftChild"]) + r["rawCount"] * rec(nd["rightChild"])) / nd["rawCount"]

    return rec(0)


def brute_shap(trees, weights, x, M):
    phi = np.zeros(M)
    for t, tree in trees.items():
        for i in range(M):
            others = [j for j in range(M) if j != i]
            for k in range(M):
                for S in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(M - k - 1) / math.factorial(M)
                    phi[i] += weights[t] * w * (_value(tree, x, set(S) | {i}) - _value(tree, x, set(S)))
    return phi


def brute_interaction(trees, weights, x, M, i, j):
    out = 0.0
    others = [k for k in range(M) if k not in (i, j)]
    for t, tree in trees.items():
        for k in range(M - 1):
            for S in itertools.combinations(others, k):
                S = set(S)
                w = math.factorial(k) * math.factorial(M - k - 2) / (2 * math.factorial(M - 1))
                out += weights[t] * w * (_value(tree, x, S | {i, j}) - _value(tree, x, S | {i}) - _value(tree, x, S | {j}) + _value(tree, x, S))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(0)
    n = 300
    X = rng.normal(size=(n, 4))
    X[:, 3] = rng.integers(0, 2, n)
    y = ((X[:, 0] + X[:, 1] * X[:, 3] + 0.5 * rng.normal(size=n)) > 0).astype(int)
    rows = [(i, *map(float, X[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int")
    feats = ["a", "b", "c", "d"]
    model = G.fit_gbt(df, feats, "y", max_iter=6, max_depth=3, subsample=0.8, seed=7)
    return df, feats, model, X


def test_shap_matches_brute_force(spark, fitted):
    df, feats, model, X = fitted
    trees = _tree_nodes(spark, model)
    leaves = G.leaf_table(model, spark)
    weights = list(model.treeWeights)
    inters = []
    for r in range(12):
        exp = brute_shap(trees, weights, X[r], 4)
        got = G.shap_matrix(leaves, X[r : r + 1])[0]
        assert np.allclose(got, exp, atol=1e-12)
        inter = G.interaction_vector(leaves, X[r : r + 1], 1, 3)[0]
        assert abs(inter - brute_interaction(trees, weights, X[r], 4, 1, 3)) < 1e-12
        inters.append(inter)
    assert max(abs(v) for v in inters) > 1e-6  # the pair does interact in this model
    # batch evaluation equals row-by-row evaluation
    assert np.allclose(G.interaction_vector(leaves, X[:12], 1, 3), inters, atol=1e-12)


def test_shap_sums_to_log_odds(spark, fitted):
    df, feats, model, X = fitted
    shap_df, base = G.tree_shap(model, df, feats, keep=["id"], interaction=("b", "d"))
    raw = model.transform(G._assemble(df, feats)).select("id", (2 * vector_to_array("rawPrediction")[1]).alias("logodds"))
    total = sum(F.col(f"shap_{f}") for f in feats) + F.lit(base)
    chk = shap_df.join(raw, "id").select(F.max(F.abs(total - F.col("logodds"))).alias("err")).first()["err"]
    assert chk < 1e-9
    imp = G.shap_importance(shap_df, feats).collect()
    assert [r["feature"] for r in imp][0] in ("a", "b")
    ex = G.explain_rows(shap_df, feats, "id").collect()
    assert {r["which"] for r in ex} == {"highest", "lowest"} and len(ex) == 8


def test_folds_are_stratified(spark):
    rows = [(i, int(i % 3 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y int")
    f = G.stratified_folds(df, "y", "id", k=5, rows_per_bucket=50)
    counts = {(r["y"], r["fold"]): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        sizes = [counts[(y, k)] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_memory_of_a_batch_does_not_grow_with_its_rows():
    import tracemalloc

    rng = np.random.default_rng(3)
    n = 300
    feats = [np.sort(rng.permutation(6)[:4]) for _ in range(n)]
    lo = [rng.normal(-1, 1, 4) for _ in range(n)]
    leaves = G.LeafTable(rng.normal(size=n), feats, lo, [v + 1.5 for v in lo], [rng.random(4) for _ in range(n)], 0.0, 6)
    x = rng.normal(size=(6000, 6))

    def peak(rows):
        tracemalloc.start()
        try:
            found = G.shap_matrix(leaves, rows), G.interaction_vector(leaves, rows, 1, 2)
            return found, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (_, _), one = peak(x[:500])
    (phi, pair), many = peak(x)
    assert many < 2 * one
    at = rng.permutation(6000)[:400]
    assert np.allclose(phi[at], G.shap_matrix(leaves, x[at]), atol=1e-12) and np.allclose(pair[at], G.interaction_vector(leaves, x[at], 1, 2), atol=1e-12)
