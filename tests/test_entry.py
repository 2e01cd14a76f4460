import duckdb

import __spark_entry__ as E
from cohortkit.plans.study import TABLES

from .conftest import SF001


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["covariate", "treated_mean", "control_mean", "treated_n", "control_n", "smd"]


def test_contract_keys_and_sql_parse():
    qs = E.queries()
    sqls = E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 60 and len(sqls) >= 40
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    for name, sql in sqls.items():
        con.execute(sql).fetchall()
