import os
import tempfile

from pyspark.sql import functions as F

from cohortkit.sources import io
from cohortkit.streaming import incremental_load

from .conftest import SF001


def test_read_raw_tokens_and_quotes(spark):
    d = tempfile.mkdtemp(prefix="ck-raw-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('subject_id,note,dod\n1,"line one\nline two",NA\n2,plain,2150-01-01\n3,,\n')
    df = io.read_raw(spark, d)
    assert df.columns == ["SUBJECT_ID", "NOTE", "DOD"]
    rows = sorted(df.collect(), key=lambda r: r["SUBJECT_ID"])
    assert len(rows) == 3  # quoted newline is one row
    assert rows[0]["NOTE"] == "line one\nline two" and rows[0]["DOD"] is None
    assert rows[2]["NOTE"] is None


def test_load_all_idempotent(spark):
    base = tempfile.mkdtemp(prefix="ck-base-")
    src = io.read_stage(spark, f"{SF001}/customer.parquet")
    src.write.option("header", True).option("compression", "gzip").csv(os.path.join(base, "hosp", "patients.csv.gz"))
    wh = tempfile.mkdtemp(prefix="ck-wh-")
    io.ensure_databases(spark, ["hosp"], location=wh)
    first = io.load_all(spark, base, {"hosp": ["patients", "missing_table"]}, suffix=".csv.gz")
    assert [(r.table, r.action) for r in first] == [("patients", "loaded"), ("missing_table", "missing_source")]
    assert first[0].expected == first[0].actual == src.count()
    second = io.load_all(spark, base, {"hosp": ["patients"]}, suffix=".csv.gz")
    assert second[0].action == "skipped"
    v = io.verify_tables(spark, [("hosp", "patients"), ("hosp", "nope")]).collect()
    assert [(r["table"], r["ok"]) for r in v] == [("patients", True), ("nope", False)]


def test_stage_and_json(spark):
    d = tempfile.mkdtemp(prefix="ck-stage-")
    df = io.read_stage(spark, f"{SF001}/region.parquet")
    io.write_stage(df, os.path.join(d, "p"))
    assert io.read_stage(spark, os.path.join(d, "p")).count() == 5
    io.write_json(df.agg(F.count(F.lit(1)).alias("n")), os.path.join(d, "j"))
    assert spark.read.json(os.path.join(d, "j")).first()["n"] == 5


def test_incremental_load_exactly_once(spark):
    src = tempfile.mkdtemp(prefix="ck-src-")
    out = tempfile.mkdtemp(prefix="ck-out-")
    ck = tempfile.mkdtemp(prefix="ck-ck-")
    nation = io.read_stage(spark, f"{SF001}/nation.parquet")
    cols = nation.columns
    nation.where("n_nationkey < 10").write.mode("append").option("header", True).csv(src)
    r1 = incremental_load(spark, src, cols, out, ck)
    assert r1["rows"] == 10
    r2 = incremental_load(spark, src, cols, out, ck)  # nothing new
    assert r2["rows"] == 0
    nation.where("n_nationkey >= 10").write.mode("append").option("header", True).csv(src)
    r3 = incremental_load(spark, src, cols, out, ck)
    assert r3["rows"] == 15
    assert spark.read.parquet(out).count() == 25


def test_load_all_sees_changed_content_and_keeps_the_old_table(spark):
    base, wh = tempfile.mkdtemp(prefix="ck-base-"), tempfile.mkdtemp(prefix="ck-wh-")
    db = "swap_test"
    io.ensure_databases(spark, [db], location=wh)

    def put(rows):
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{base}/{db}/t.csv.gz")

    def load():
        return [(r.action, r.expected, r.actual) for r in io.load_all(spark, base, {db: ["t"]})]

    held = lambda: sorted(tuple(r) for r in spark.table(f"{db}.t").collect())
    put([(1, "a"), (2, "b")])
    assert load() == [("loaded", 2, 2)] and load() == [("skipped", 2, 2)]
    put([(1, "a"), (2, "c")])  # as many rows, other content
    assert load() == [("reloaded", 2, 2)] and held() == [("1", "a"), ("2", "c")]
    # a load that broke between the two renames: the old table comes back
    spark.sql(f"ALTER TABLE {db}.t RENAME TO {db}.t__old")
    spark.range(3).write.saveAsTable(f"{db}.t__new")
    io.recover_table(spark, db, "t")
    assert held() == [("1", "a"), ("2", "c")] and not io.table_exists(spark, db, "t__new") and not io.table_exists(spark, db, "t__old")
    # one that broke while it wrote
    failing = spark.range(5).select(F.expr("CAST(id AS STRING)").alias("id"), F.expr("IF(id = 4, raise_error('broken'), 'x')").alias("v"))
    try:
        io.load_table(failing, db, "t")
        raise AssertionError("must fail")
    except Exception as e:  # noqa: BLE001
        assert "broken" in str(e)
    io.recover_table(spark, db, "t")
    assert held() == [("1", "a"), ("2", "c")] and load() == [("skipped", 2, 2)]
    spark.sql(f"DROP DATABASE {db} CASCADE")
