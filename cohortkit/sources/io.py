"""Sources and sinks: raw gzipped CSV, managed tables, stage hand-off and
result files.

The reference loads each raw file in pandas chunks of 500,000 rows and
appends them to a warehouse table. On Spark the whole file is one
DataFrame: executors parse it and write the table in one job, and
reconciliation compares parsed rows with table rows (not physical lines,
which miscount quoted newlines).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import null_tokens


# --------------------------------------------------------------------------- IO1
def read_raw(spark: SparkSession, path: str, columns: Sequence[str] | None = None, upper: bool = True, partitions: int | None = None, multi_line: bool = True) -> DataFrame:
    """Read headered CSV (optionally .gz) with every column as string.

    The usual missing-value tokens become NULL. ``multi_line`` parses quoted
    newlines, at the price of one task per file; set it to False for plain
    files without them, which are then split. A gzip file is never splittable, so the rows are spread over
    ``partitions`` afterwards when given.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("mode", "FAILFAST")
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType(), True) for c in columns]))
    else:
        reader = reader.option("inferSchema", False)
    df = reader.csv(path)
    df = df.select(*[null_tokens(F.col(f"`{c}`")).alias(c.upper() if upper else c) for c in df.columns])
    return df.repartition(partitions) if partitions else df


# --------------------------------------------------------------------------- IO3 / IO4
def ensure_databases(spark: SparkSession, names: Iterable[str], location: str | None = None) -> list[str]:
    """CREATE DATABASE IF NOT EXISTS for each name (optionally under ``location``)."""
    made = []
    for n in names:
        loc = f" LOCATION '{location.rstrip('/')}/{n}.db'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{n}`{loc}")
        made.append(n)
    return made


def table_exists(spark: SparkSession, db: str, name: str) -> bool:
    return spark.catalog.tableExists(f"{db}.{name}")


# --------------------------------------------------------------------------- IO2 / IO11
def load_table(df: DataFrame, db: str, name: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None, fmt: str = "parquet") -> str:
    """Write ``df`` as managed table ``db.name`` in one job; returns the name.

    The database name is used as given (no target-schema prefix). An existing
    table is replaced whole: the new one is written beside it and then takes its
    name, so a load that breaks leaves the old table (see ``recover_table``).
    """
    spark = df.sparkSession
    recover_table(spark, db, name)
    swap = mode == "overwrite" and table_exists(spark, db, name)
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(f"`{db}`.`{name}{_NEW}`" if swap else f"`{db}`.`{name}`")
    if swap:
        spark.sql(f"ALTER TABLE `{db}`.`{name}` RENAME TO `{db}`.`{name}{_OLD}`")
        spark.sql(f"ALTER TABLE `{db}`.`{name}{_NEW}` RENAME TO `{db}`.`{name}`")
        spark.sql(f"DROP TABLE `{db}`.`{name}{_OLD}`")
    return f"{db}.{name}"


_NEW, _OLD = "__new", "__old"


def recover_table(spark: SparkSession, db: str, name: str) -> None:
    """Clear up after a load that broke: the old table gets its name back unless the new one already has it."""
    if table_exists(spark, db, name + _OLD):
        if table_exists(spark, db, name):
            spark.sql(f"DROP TABLE `{db}`.`{name}{_OLD}`")
        else:
            spark.sql(f"ALTER TABLE `{db}`.`{name}{_OLD}` RENAME TO `{db}`.`{name}`")
    if table_exists(spark, db, name + _NEW):
        spark.sql(f"DROP TABLE `{db}`.`{name}{_NEW}`")


def materialize(df: DataFrame, db: str | None, name: str, kind: str = "view") -> DataFrame:
    """Staging models are lazy views; marts are tables (lineage cut)."""
    spark = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if kind == "table":
        load_table(df, db or "default", name)
        return spark.table(f"`{db or 'default'}`.`{name}`")
    raise ValueError("kind is 'view' or 'table'")


# --------------------------------------------------------------------------- IO6
@dataclass
class LoadResult:
    db: str
    table: str
    action: str  # missing_source | skipped | loaded | reloaded
    expected: int | None
    actual: int | None


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _checksum(df: DataFrame):
    """Row count and a sum of row hashes that does not depend on the order of the rows."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum")]


def load_all(spark: SparkSession, base: str, manifest: dict[str, Sequence[str]], suffix: str = ".csv.gz", partitions: int | None = None, multi_line: bool = True) -> list[LoadResult]:
    """Idempotent load of ``base/<db lower>/<table><suffix>`` into ``db.table``.

    Missing file -> skipped; existing table with the columns and the content
    (row count and checksum of the parsed rows) of the source -> kept;
    otherwise (re)loaded and reconciled, the old table staying until the new one
    is whole. A first load parses its source once: the parsed rows are counted
    and summed while they are written.
    """
    ensure_databases(spark, manifest.keys())
    out = []
    for db, tables in manifest.items():
        for t in tables:
            path = f"{base.rstrip('/')}/{db.lower()}/{t}{suffix}"
            if not _path_exists(spark, path):
                out.append(LoadResult(db, t, "missing_source", None, None))
                continue
            src = read_raw(spark, path, partitions=partitions, multi_line=multi_line)
            recover_table(spark, db, t)
            action = "loaded"
            if table_exists(spark, db, t):
                old = spark.table(f"`{db}`.`{t}`")
                if sorted(old.columns) == sorted(src.columns):
                    have, want = old.agg(*_checksum(old)).first(), src.agg(*_checksum(src)).first()
                    if have == want:
                        out.append(LoadResult(db, t, "skipped", want["rows"], have["rows"]))
                        continue
                action = "reloaded"
            parsed = Observation()
            load_table(src.observe(parsed, *_checksum(src)), db, t)
            new = spark.table(f"`{db}`.`{t}`")
            actual = new.agg(*_checksum(new)).first()
            if actual["checksum"] != parsed.get["checksum"]:
                raise RuntimeError(f"{db}.{t}: the table does not hold what was parsed")
            out.append(LoadResult(db, t, action, parsed.get["rows"], actual["rows"]))
    return out


# --------------------------------------------------------------------------- IO7
def verify_tables(spark: SparkSession, names: Sequence[tuple[str, str]]) -> DataFrame:
    """``(db, table, exists, rows, ok)`` for each expected table."""
    rows = []
    for db, t in names:
        exists = table_exists(spark, db, t)
        n = spark.table(f"`{db}`.`{t}`").count() if exists else None
        rows.append((db, t, exists, n, bool(exists)))
    return spark.createDataFrame(rows, "db string, table string, exists boolean, rows long, ok boolean")


# --------------------------------------------------------------------------- IO9 / IO10 (IO8 is spark.table)
def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> str:
    """Result tables as JSON lines, one file per partition."""
    df.write.mode("overwrite").json(path)
    return path
