import numpy as np
from pyspark.sql import functions as F

from cohortkit.operators.quantiles import exact_quantiles


def test_exact_quantiles_match_percentile(spark):
    rng = np.random.default_rng(31)
    n = 3000
    rows = [(str(g), float(a) if rng.random() > 0.1 else None, float(b)) for g, a, b in zip(rng.choice(["x", "y", "z"], n), np.round(rng.normal(size=n), 2), rng.integers(0, 7, n))]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r["g"], r["column"]): [r[f"q_{i}"] for i in range(len(probs))] for r in exact_quantiles(df, ["a", "b"], probs, by=["g"], rows_per_block=200).collect()}
    for c in ("a", "b"):
        exp = df.groupBy("g").agg(F.percentile(F.col(c), F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
        for r in exp:
            assert np.allclose(got[(r["g"], c)], r["q"], atol=1e-12)
    # whole-table (no group) and numpy agreement
    whole = exact_quantiles(df, ["b"], [0.5], rows_per_block=100).first()["q_0"]
    assert whole == float(np.median([r[2] for r in rows]))


def test_describe_and_medians_with_null_groups_and_heavy_values(spark):
    from cohortkit.operators.balance import medians
    from cohortkit.operators.describe import describe

    rng = np.random.default_rng(5)
    groups = rng.choice(["a", "b", ""], 900)
    rows = [(str(g) or None, [0.0, None, float(v)][k]) for g, v, k in zip(groups, rng.normal(size=900), rng.choice([0, 1, 2], 900, p=[0.5, 0.2, 0.3]))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in describe(df, ["v"], by="g").collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        v = np.array([x for k, x in rows if k == g and x is not None])
        want = [v.mean(), v.std(ddof=1), v.min(), *np.quantile(v, [0.25, 0.5, 0.75]), v.max()]
        assert r["count"] == len(v) and np.allclose(want, [r[c] for c in ("mean", "std", "min", "q25", "median", "q75", "max")], atol=1e-12)
    assert medians(df, ["v"])["v"] == np.median([x for _, x in rows if x is not None])
    assert [(r["count"], r["median"]) for r in describe(df.where("false"), ["v"]).collect()] == [(0, None)]


def test_running_sums_across_partitions(spark):
    from pyspark.sql import Window

    from cohortkit.operators.running import running_sums

    rng = np.random.default_rng(17)
    rows = [(str(g), int(t), float(v)) for g, t, v in zip(rng.choice(["a", "b", "c"], 600), range(600), rng.normal(size=600))]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    for desc in (False, True):
        got = {(r["g"], r["t"]): r["v_cum"] for r in running_sums(df, "t", ["v"], ["g"], descending=desc, rows_per_block=37).collect()}
        order = F.col("t").desc() if desc else F.col("t").asc()
        w = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        exp = {(r["g"], r["t"]): r["c"] for r in df.withColumn("c", F.sum("v").over(w)).collect()}
        assert got.keys() == exp.keys()
        assert max(abs(got[k] - exp[k]) for k in exp) < 1e-9


def test_running_sums_keep_types_and_null_keys(spark):
    from cohortkit.operators.running import running_sums

    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1)], "g string, t long, v long")
    out = running_sums(df, "t", ["v"], ["g"], rows_per_block=1)
    assert out.schema["v_cum"].dataType.simpleString() == "bigint"
    assert {(r["g"], r["t"], r["v_cum"]) for r in out.collect()} == {(None, 1, 5), (None, 2, 12), ("a", 1, 1)}
