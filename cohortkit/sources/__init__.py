"""Sources and sinks (raw CSV, managed tables, stage parquet, JSON results)."""

from .io import (  # noqa: F401
    ensure_databases,
    load_all,
    load_table,
    materialize,
    read_raw,
    read_stage,
    table_exists,
    verify_tables,
    write_json,
    write_stage,
)
