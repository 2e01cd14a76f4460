"""Gradient-boosted trees and exact tree SHAP on Spark.

* ``fit_gbt`` / ``predict_proba``: Spark ML ``GBTClassifier`` (same model
  family as the reference, not the same numbers: Spark's first tree has
  weight 1 and labels are +-1).
* ``stratified_folds`` / ``stratified_cv_auc``: exact per-class fold
  balance without a window over a whole class (hash buckets + per-bucket
  offsets), AUC by the exact distributed ``roc_auc``.
* ``tree_shap``: exact path-dependent Shapley values per row. The model's
  leaves (bounded by trees x 2^depth) form a small table broadcast to the
  executors; rows stream through ``mapInPandas`` in Arrow batches, of which
  ``SLICE`` rows at a time meet the leaves. For a leaf
  with path features P (d = |P|), value v, cover ratio product z_f and
  indicator o_f(x) (x inside the leaf's merged interval of f):
      phi_i += v (o_i - z_i) sum_{S in P\\{i}} |S|! (d-|S|-1)! / d! prod_S o prod_rest z
  (the value function is a product over path features, so features off the
  path are dummy players). Values are on the log-odds scale
  (log-odds = 2 * Spark's margin), so they add up to the log-odds minus the
  base value.
* ``tree_shap_interaction``: the same sum for a pair with
  (o_i - z_i)(o_j - z_j) and weights |S|! (d-|S|-2)! / (2 (d-1)!).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that meet a block of leaves at once: their arrays fit the cache and do not grow with the Arrow batch.
SLICE = 512


# --------------------------------------------------------------------------- G1 / G11
def _assemble(df: DataFrame, features: Sequence[str], out: str = "__features") -> DataFrame:
    casted = df
    for f in features:
        casted = casted.withColumn(f, F.col(f).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(casted)


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, max_iter: int = 200, step_size: float = 0.05, max_depth: int = 4, subsample: float = 0.8, seed: int = 42) -> GBTClassificationModel:
    """Fit on rows complete in features and label."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    data = _assemble(complete_rows(df, [*features, label]), features).withColumn("__label", F.col(label).cast("double"))
    gbt = GBTClassifier(
        featuresCol="__features",
        labelCol="__label",
        maxIter=max_iter,
        stepSize=step_size,
        maxDepth=max_depth,
        subsamplingRate=subsample,
        seed=seed,
        checkpointInterval=10,
    )
    return gbt.fit(data)


def predict_proba(model: GBTClassificationModel, df: DataFrame, features: Sequence[str], out: str = "predicted_proba") -> DataFrame:
    """Adds P(label = 1) (and keeps the other columns)."""
    scored = model.transform(_assemble(df, features))
    return scored.withColumn(out, vector_to_array(F.col(model.getProbabilityCol()))[1]).drop("__features", model.getRawPredictionCol(), model.getProbabilityCol(), model.getPredictionCol())


# --------------------------------------------------------------------------- G2
def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42, rows_per_bucket: int = 500_000) -> DataFrame:
    """Adds ``fold`` in 0..k-1 with per-class fold sizes differing by at most one.

    Rows get a seeded hash; the rank of the hash inside its class modulo k
    is the fold. The rank is exact without a window over a whole class: the
    hash range is cut into buckets (high bits, so bucket order = hash order),
    each (class, bucket) is ranked on its own, and per-bucket offsets (one
    number per bucket) are added.
    """
    from pyspark.sql import Window

    n = df.count()
    buckets = max(1, math.ceil(n / rows_per_bucket))
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    x = df.withColumn("__h", h).withColumn(
        "__b", F.least(F.floor((F.col("__h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64 / buckets)), F.lit(buckets - 1)).cast("int")
    )
    counts = x.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # (class, bucket) table: at most classes x buckets rows
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w_off), F.lit(0))).select(label, "__b", "__off")
    w = Window.partitionBy(label, "__b").orderBy("__h", id_col)
    from .cohort import broadcast_if_small

    ranked = x.join(broadcast_if_small(offsets, 1_000_000), on=[label, "__b"], how="inner").withColumn("__rn", F.row_number().over(w) - 1)
    return ranked.withColumn("fold", F.pmod(F.col("__off") + F.col("__rn"), F.lit(k)).cast("int")).drop("__h", "__b", "__rn", "__off")


def stratified_cv_auc(df: DataFrame, features: Sequence[str], label: str, id_col: str, k: int = 5, seed: int = 42, parallelism: int | None = None, **gbt) -> DataFrame:
    """Per-fold AUC of the GBT: ``(fold, auc)`` plus a summary row
    (fold = -1 mean, fold = -2 population SD)."""
    from .survival import roc_auc

    from concurrent.futures import ThreadPoolExecutor

    data = stratified_folds(complete_rows(df, [*features, label]), label, id_col, k, seed).checkpoint(eager=True)
    spark = df.sparkSession

    def one_fold(f: int) -> float:
        model = fit_gbt(data.where(F.col("fold") != f), features, label, seed=seed, **gbt)
        scored = predict_proba(model, data.where(F.col("fold") == f), features)
        auc = roc_auc(scored, "predicted_proba", label).first()["auc"]
        return float("nan") if auc is None else float(auc)  # one-class fold

    # folds are independent Spark jobs: submit them concurrently (as
    # CrossValidator's ``parallelism`` does) so small per-tree jobs overlap
    with ThreadPoolExecutor(max_workers=parallelism or k) as pool:
        aucs = list(pool.map(one_fold, range(k)))
    rows = [(f, a) for f, a in enumerate(aucs)] + [(-1, float(np.nanmean(aucs))), (-2, float(np.nanstd(aucs)))]
    return spark.createDataFrame(rows, "fold int, auc double")


# --------------------------------------------------------------------------- leaves
@dataclass
class LeafTable:
    """Per leaf: tree weight x value, path features, merged intervals, z."""

    weight_value: np.ndarray  # (L,)
    features: list[np.ndarray]  # per leaf: path feature indices
    lo: list[np.ndarray]
    hi: list[np.ndarray]
    z: list[np.ndarray]
    base_margin: float
    n_features: int


def leaf_table(model: GBTClassificationModel, spark: SparkSession) -> LeafTable:
    """Walk every tree of a fitted model (read from its saved node data)."""
    from ..session import scratch_path

    path = scratch_path(spark, "gbt-model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    weights = list(model.treeWeights)
    by_tree: dict[int, dict[int, object]] = {}
    for r in nodes:
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    wv, feats, los, his, zs = [], [], [], [], []
    base = 0.0
    for t, tree in by_tree.items():
        w = weights[t]
        root_id = 0 if 0 in tree else min(tree)
        root_cover = float(tree[root_id]["rawCount"])
        stack = [(root_id, {}, 1.0)]
        while stack:
            nid, cons, _ = stack.pop()
            node = tree[nid]
            if node["leftChild"] < 0:
                cover = float(node["rawCount"])
                base += w * node["prediction"] * cover / root_cover
                fs = sorted(cons)
                wv.append(w * node["prediction"])
                feats.append(np.array(fs, dtype=np.int64))
                los.append(np.array([cons[f][0] for f in fs], float))
                his.append(np.array([cons[f][1] for f in fs], float))
                zs.append(np.array([cons[f][2] for f in fs], float))
                continue
            f = node["split"]["featureIndex"]
            thr = float(node["split"]["leftCategoriesOrThreshold"][0])
            cover = float(node["rawCount"])
            for child, goes_left in ((node["leftChild"], True), (node["rightChild"], False)):
                c = dict(cons)
                lo, hi, z = c.get(f, (-math.inf, math.inf, 1.0))
                ratio = float(tree[child]["rawCount"]) / cover if cover > 0 else 0.0
                c[f] = (lo, min(hi, thr), z * ratio) if goes_left else (max(lo, thr), hi, z * ratio)
                stack.append((child, c, 0.0))
    return LeafTable(np.array(wv, float), feats, los, his, zs, base, model.numFeatures)


def _shapley_weights(d: int) -> np.ndarray:
    return np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)], float)


def _interaction_weights(d: int) -> np.ndarray:
    return np.array([math.factorial(s) * math.factorial(d - s - 2) / (2.0 * math.factorial(d - 1)) for s in range(max(d - 1, 0))], float)


def _leaf_groups(leaves: LeafTable, block: int = 128):
    """Leaves grouped by path length, as stacked arrays in blocks (cached)."""
    cached = getattr(leaves, "_groups", None)
    if cached is not None:
        return cached
    by_d: dict[int, list[int]] = {}
    for l_, fs in enumerate(leaves.features):
        if len(fs):
            by_d.setdefault(len(fs), []).append(l_)
    groups = []
    for d, ids in sorted(by_d.items()):
        for i in range(0, len(ids), block):
            sel = ids[i : i + block]
            groups.append(
                (
                    d,
                    np.stack([leaves.features[j] for j in sel]),  # (L, d)
                    np.stack([leaves.lo[j] for j in sel]),
                    np.stack([leaves.hi[j] for j in sel]),
                    np.stack([leaves.z[j] for j in sel]),
                    leaves.weight_value[sel],
                )
            )
    object.__setattr__(leaves, "_groups", groups)
    return groups


def shap_matrix(leaves: LeafTable, x: np.ndarray) -> np.ndarray:
    """SHAP values (m x n_features) on Spark's margin scale for a batch.

    Leaves with the same path length are evaluated together: indicators are
    (m, L, d) arrays, the subset sums are polynomial coefficients over the
    other path features, and the per-leaf contributions are added into the
    feature columns with one matrix product per path position.
    """
    m = x.shape[0]
    if m > SLICE:
        return np.concatenate([shap_matrix(leaves, x[i : i + SLICE]) for i in range(0, m, SLICE)])
    nf = leaves.n_features
    phi = np.zeros((m, nf))
    for d, feats, lo, hi, z, v in _leaf_groups(leaves):
        xv = x[:, feats]  # (m, L, d)
        o = ((xv > lo[None]) & (xv <= hi[None])).astype(float)
        wts = _shapley_weights(d)
        n_leaves = feats.shape[0]
        for i in range(d):
            others = [k for k in range(d) if k != i]
            coefs = [np.ones((m, n_leaves))]
            for k in others:
                ok, zk = o[:, :, k], z[None, :, k]
                nxt = [coefs[0] * zk]
                for s_ in range(1, len(coefs)):
                    nxt.append(coefs[s_] * zk + coefs[s_ - 1] * ok)
                nxt.append(coefs[-1] * ok)
                coefs = nxt
            acc = sum(wts[s_] * c for s_, c in enumerate(coefs))
            contrib = v[None, :] * (o[:, :, i] - z[None, :, i]) * acc  # (m, L)
            onehot = np.zeros((n_leaves, nf))
            onehot[np.arange(n_leaves), feats[:, i]] = 1.0
            phi += contrib @ onehot
    return phi


def interaction_vector(leaves: LeafTable, x: np.ndarray, fi: int, fj: int) -> np.ndarray:
    """SHAP interaction value (i, j), i != j, on the margin scale.

    Vectorised over blocks of leaves whose path holds both features; their
    positions differ per leaf, so in the subset polynomial those two
    positions are replaced by the neutral factor (z = 1, o = 0).
    """
    m = x.shape[0]
    if m > SLICE:
        return np.concatenate([interaction_vector(leaves, x[i : i + SLICE], fi, fj) for i in range(0, m, SLICE)])
    out = np.zeros(m)
    for d, feats, lo, hi, z, v in _leaf_groups(leaves):
        if d < 2:
            continue
        has_i, has_j = feats == fi, feats == fj
        sel = has_i.any(axis=1) & has_j.any(axis=1)
        if not sel.any():
            continue
        f_, lo_, hi_, z_, v_ = feats[sel], lo[sel], hi[sel], z[sel], v[sel]
        ki, kj = has_i[sel].argmax(axis=1), has_j[sel].argmax(axis=1)
        n_leaves = f_.shape[0]
        ar = np.arange(n_leaves)
        xv = x[:, f_]
        o = ((xv > lo_[None]) & (xv <= hi_[None])).astype(float)  # (m, L, d)
        coefs = [np.ones((m, n_leaves))]
        for k in range(d):
            neutral = (ki == k) | (kj == k)
            ok = np.where(neutral[None, :], 0.0, o[:, :, k])
            zk = np.where(neutral, 1.0, z_[:, k])[None, :]
            nxt = [coefs[0] * zk]
            for s_ in range(1, len(coefs)):
                nxt.append(coefs[s_] * zk + coefs[s_ - 1] * ok)
            nxt.append(coefs[-1] * ok)
            coefs = nxt
        wts = _interaction_weights(d)
        acc = sum(wts[s_] * coefs[s_] for s_ in range(d - 1))
        pair = (o[:, ar, ki] - z_[ar, ki][None, :]) * (o[:, ar, kj] - z_[ar, kj][None, :])
        out += (v_[None, :] * pair * acc).sum(axis=1)
    return out


# --------------------------------------------------------------------------- G4
def tree_shap(model: GBTClassificationModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), interaction: tuple[str, str] | None = None) -> tuple[DataFrame, float]:
    """Per-row feature values, SHAP values ``shap_<feature>`` on the log-odds
    scale and ``predicted_proba``; returns (frame, base value in log-odds).

    With ``interaction=(a, b)`` a column ``shap_interaction`` holds the
    (a, b) interaction value. Rows with NULL features are dropped.
    """
    spark = df.sparkSession
    feats = list(features)
    leaves = leaf_table(model, spark)
    b_leaves = spark.sparkContext.broadcast(leaves)
    pair = (feats.index(interaction[0]), feats.index(interaction[1])) if interaction else None
    keep = list(keep)
    data = complete_rows(df, feats).select(*keep, *[F.col(f).cast("double").alias(f) for f in feats])
    fields = [f"`{c}` {data.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join(fields + [f"`{f}` double" for f in feats] + [f"`shap_{f}` double" for f in feats] + ["predicted_proba double"] + (["shap_interaction double"] if pair else []))

    def run(it):
        lv = b_leaves.value
        for pdf in it:
            x = pdf[feats].to_numpy(dtype=float)
            phi = shap_matrix(lv, x)
            margin = phi.sum(axis=1) + lv.base_margin
            out = pdf[keep + feats].copy()
            for j, f in enumerate(feats):
                out[f"shap_{f}"] = 2.0 * phi[:, j]
            out["predicted_proba"] = 1.0 / (1.0 + np.exp(-2.0 * margin))
            if pair:
                out["shap_interaction"] = 2.0 * interaction_vector(lv, x, pair[0], pair[1])
            yield out

    return data.mapInPandas(run, schema), 2.0 * leaves.base_margin


# --------------------------------------------------------------------------- G6 / G7
def shap_importance(shap_df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean |SHAP| per feature, sorted descending: ``(feature, mean_abs_shap)``."""
    wide = shap_df.agg(*[F.avg(F.abs(F.col(f"shap_{f}"))).alias(f"a{i}") for i, f in enumerate(features)])
    parts = ", ".join(f"'{f}', a{i}" for i, f in enumerate(features))
    return wide.selectExpr(f"stack({len(features)}, {parts}) as (feature, mean_abs_shap)").orderBy(F.col("mean_abs_shap").desc(), "feature")


def shap_long(shap_df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """Beeswarm / dependence data: ``(id, feature, value, shap)``."""
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col(f"shap_{f}").alias("shap")) for f in features]
    return shap_df.select(F.col(id_col), F.explode(F.array(*entries)).alias("__x")).select(id_col, "__x.*")


# --------------------------------------------------------------------------- G9
def explain_rows(shap_df: DataFrame, features: Sequence[str], id_col: str, score: str = "predicted_proba", base_value: float | None = None, show: Sequence[str] = ()) -> DataFrame:
    """Highest- and lowest-score rows with their per-feature contributions
    ordered by |SHAP|: ``(which, id, score, feature, value, shap, rank)``.

    Waterfall data: ``base_value`` adds the model's base value and ``total``
    (base plus all contributions of the row); ``show`` adds columns of the row
    such as the actual outcome and the arm, as ``row_<name>``.
    """
    from pyspark.sql import Window

    from .describe import extreme_rows

    ext = extreme_rows(shap_df, id_col, score).select("which", id_col)
    rows = shap_df.join(ext, on=id_col, how="inner")
    long = shap_long(rows.withColumn("__which", F.col("which")).withColumn("__score", F.col(score)), features, id_col)
    meta = rows.select(id_col, "which", F.col(score).alias("score"), *[F.col(c).alias(f"row_{c}") for c in show])
    more = [f"row_{c}" for c in show]
    if base_value is not None:
        meta = meta.withColumn("base_value", F.lit(float(base_value)))
        long = long.withColumn("total", F.lit(float(base_value)) + F.sum("shap").over(Window.partitionBy(id_col)))
        more += ["base_value", "total"]
    w = Window.partitionBy(id_col).orderBy(F.abs(F.col("shap")).desc(), F.col("feature"))
    return long.join(meta, on=id_col).withColumn("rank", F.row_number().over(w)).select("which", id_col, "score", "feature", "value", "shap", "rank", *more)
