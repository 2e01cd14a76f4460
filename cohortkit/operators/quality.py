"""Data-quality checks: expectations, source tests, count reconciliation,
missingness and zero counts. Each check is one aggregation pass; the result
is a small DataFrame (one row per check / column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stack(wide: DataFrame, names: Sequence[str], value_cols: Sequence[Sequence[str]], out: Sequence[str], key: str = "column") -> DataFrame:
    """Unpivot a one-row aggregate: one output row per name (``stack``)."""
    parts = []
    for name, cols in zip(names, value_cols):
        parts.append("'" + name.replace("'", "''") + "'")
        parts.extend(f"`{c}`" for c in cols)
    expr = f"stack({len(names)}, {', '.join(parts)}) as ({key}, {', '.join(out)})"
    return wide.selectExpr(expr)


# --------------------------------------------------------------------------- P18
def expect(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Row-level assertions: ``(check, n_rows, n_bad, ok)`` per named condition.

    A row is bad when the condition is false or NULL.
    """
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, (_, cond) in enumerate(checks):
        aggs.append(F.count_if(~F.coalesce(cond, F.lit(False))).alias(f"__b{i}"))
    wide = df.agg(*aggs)
    long = _stack(wide, [c for c, _ in checks], [["__n", f"__b{i}"] for i in range(len(checks))], ["n_rows", "n_bad"], key="check")
    return long.select("check", F.col("n_rows").cast("long"), F.col("n_bad").cast("long"), (F.col("n_bad") == 0).alias("ok"))


# --------------------------------------------------------------------------- P19
def expect_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, n_rows, n_null, ok)`` for each column, one pass."""
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count_if(F.col(c).isNull()).alias(f"__x{i}") for i, c in enumerate(cols)]
    long = _stack(df.agg(*aggs), list(cols), [["__n", f"__x{i}"] for i in range(len(cols))], ["n_rows", "n_null"])
    return long.select("column", F.col("n_rows").cast("long"), F.col("n_null").cast("long"), (F.col("n_null") == 0).alias("ok"))


def expect_unique(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """One row: ``(columns, n_rows, n_distinct, n_duplicate_keys, n_duplicate_rows, ok)``.

    Counts per key with partial aggregation; only the key counts shuffle.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    per_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    res = per_key.agg(
        F.sum("__c").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.count_if(F.col("__c") > 1).alias("n_duplicate_keys"),
        F.sum(F.when(F.col("__c") > 1, F.col("__c")).otherwise(F.lit(0))).alias("n_duplicate_rows"),
    )
    return res.select(
        F.lit(",".join(cols)).alias("columns"),
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
        F.col("n_distinct").cast("long"),
        F.col("n_duplicate_keys").cast("long"),
        F.coalesce(F.col("n_duplicate_rows"), F.lit(0)).cast("long").alias("n_duplicate_rows"),
        (F.col("n_duplicate_keys") == 0).alias("ok"),
    )


# --------------------------------------------------------------------------- IO5
def reconcile_counts(pairs: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """``(table, expected, actual, ok)``: parsed source rows vs loaded table rows."""
    from functools import reduce

    rows = []
    for name, src, tgt in pairs:
        both = src.select(F.lit(1).alias("__s"), F.lit(0).alias("__t")).unionByName(tgt.select(F.lit(0).alias("__s"), F.lit(1).alias("__t")))
        rows.append(both.agg(F.lit(name).alias("table"), F.sum("__s").cast("long").alias("expected"), F.sum("__t").cast("long").alias("actual")))
    out = reduce(lambda x, y: x.unionByName(y), rows)
    return out.withColumn("ok", F.col("expected") == F.col("actual"))


# --------------------------------------------------------------------------- A10
def missingness(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = False) -> DataFrame:
    """``(column, n_missing, pct_missing)`` sorted by pct descending, one pass.

    ``pct_missing`` is unrounded (round only for display).
    """
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count_if(F.col(c).isNull()).alias(f"__m{i}") for i, c in enumerate(cols)]
    long = _stack(df.agg(*aggs), cols, [["__n", f"__m{i}"] for i in range(len(cols))], ["n_rows", "n_missing"])
    out = long.select(
        "column",
        F.col("n_missing").cast("long"),
        F.try_divide(F.col("n_missing") * F.lit(100.0), F.col("n_rows")).alias("pct_missing"),
    )
    if only_missing:
        out = out.where(F.col("n_missing") > 0)
    return out.orderBy(F.col("pct_missing").desc(), F.col("column"))


# --------------------------------------------------------------------------- A11
def zero_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, n_zero)``: values equal to 0 per column."""
    aggs = [F.count_if(F.col(c) == 0).alias(f"__z{i}") for i, c in enumerate(cols)]
    long = _stack(df.agg(*aggs), list(cols), [[f"__z{i}"] for i in range(len(cols))], ["n_zero"])
    return long.select("column", F.col("n_zero").cast("long"))


# --------------------------------------------------------------------------- A14
def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, n_distinct)`` ignoring NULLs (constant column test: <= 1)."""
    aggs = [F.count_distinct(F.col(c)).alias(f"__d{i}") for i, c in enumerate(cols)]
    long = _stack(df.agg(*aggs), list(cols), [[f"__d{i}"] for i in range(len(cols))], ["n_distinct"])
    return long.select("column", F.col("n_distinct").cast("long"))
