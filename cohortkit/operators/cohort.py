"""Cohort construction: first-per-group, semi joins, windowed event joins,
exposure flags, first-value covariates, outcome and the analysis mart.

Scale notes
-----------
* The event table is the big side. ``events_in_window`` joins on the
  subject key *and* a time bucket as wide as the window, so a subject with a
  huge history only meets the events near each index time (no all-pairs
  product per subject). The index side is broadcast only after its row count
  has been checked; otherwise both sides shuffle on (key, bucket) and AQE
  splits skewed buckets.
* Aggregates after the join group by the unit id (unique per index row), so
  partial aggregation collapses each map partition before the shuffle.
* ``first_event_after`` is an exact forward as-of lookup without a window
  bound; it never pairs an index row with all later events (see its doc).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import add_hours, assign_arm, flag, wall_micros

DEFAULT_BROADCAST_ROWS = 2_000_000


def _cols(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _epoch_micros(c: Column) -> Column:
    return wall_micros(c)


# --------------------------------------------------------------------------- W1
def sequence_number(df: DataFrame, partition_by: str | Sequence[str], order_by: Sequence[Column | str], tiebreak: str | Sequence[str], name: str = "seq") -> DataFrame:
    """Add ``row_number()`` within ``partition_by`` ordered by ``order_by`` then the unique ``tiebreak``.

    Columns given by name sort ascending with NULLs last (the warehouse
    default; Spark's own default puts NULLs first).
    """
    order = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order_by] + [F.col(t).asc_nulls_last() for t in _cols(tiebreak)]
    w = Window.partitionBy(*_cols(partition_by)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def first_per(df: DataFrame, partition_by: str | Sequence[str], order_by: Sequence[Column | str], tiebreak: str | Sequence[str]) -> DataFrame:
    """Keep the first row per group.

    ``row_number() = 1`` is planned as a WindowGroupLimit with a partial limit
    before the shuffle, so a hot group sends at most one row per map task.
    """
    return sequence_number(df, partition_by, order_by, tiebreak, "__rn").where(F.col("__rn") == 1).drop("__rn")


# --------------------------------------------------------------------------- J2
def has_any(df: DataFrame, keys_df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs at least once in ``keys_df`` (semi join on distinct keys)."""
    keys = _cols(key)
    return df.join(keys_df.select(*keys).distinct(), on=keys, how="left_semi")


# --------------------------------------------------------------------------- J4
def broadcast_if_small(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven to be at most
    ``max_rows`` (one counting job); otherwise leave the join to a shuffle."""
    if max_rows is None or max_rows <= 0:
        return df
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df




# --------------------------------------------------------------------------- P3 / P4 with code lists as tables
def _listed(df: DataFrame, max_bytes: int) -> DataFrame:
    """Mark a code list for broadcast if its measured size (keys and 32 bytes a row) is within ``max_bytes``."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(32))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def _spelled(c: Column, normalise: bool) -> Column:
    c = c.cast("string")
    return F.regexp_replace(c, r"\.", "") if normalise else c


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def flag_by_table(df: DataFrame, code: str, version: str, codes: DataFrame, out: str, normalise: bool = False, max_bytes: int = 64_000_000) -> DataFrame:
    """Add ``out``: 1 where (version, code) stands in ``codes`` (version, code), else 0; for lists too long for ``flag_codes``.

    Dots are ignored on both sides with ``normalise``. NULL codes or versions
    are never listed; repeated list rows count once. The list is broadcast
    behind a check of its size, else both sides are shuffled by code.
    """
    listed = codes.select(F.col(codes.columns[0]).cast("string").alias("__version"), _spelled(F.col(codes.columns[1]), normalise).alias("__code"))
    listed = listed.dropna().distinct()
    hit = _fresh(df, "__hit")
    listed = _listed(listed, max_bytes).withColumn(hit, F.lit(1))
    same = (F.col(version).cast("string") == F.col("__version")) & (_spelled(F.col(code), normalise) == F.col("__code"))
    joined = df.join(listed, same, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.coalesce(F.col(hit), F.lit(0)).alias(out))


def categorize_by_table(df: DataFrame, key: str, mapping: DataFrame, out: str, default: str = "other", normalise: bool = False, max_bytes: int = 64_000_000) -> DataFrame:
    """Add ``out``: the category of ``key`` in ``mapping`` (key, category, precedence), else ``default``.

    A key listed more than once takes the least precedence, then the first
    category in order. NULL keys get ``default``. Joined as ``flag_by_table`` does.
    """
    k, c, rank = mapping.columns[:3]
    first = F.min(F.struct(F.col(rank).alias("r"), F.col(c).alias("c")))["c"]
    found = _fresh(df, "__category")
    listed = mapping.filter(F.col(k).isNotNull()).groupBy(_spelled(F.col(k), normalise).alias("__key")).agg(first.alias(found))
    joined = df.join(_listed(listed, max_bytes), _spelled(F.col(key), normalise) == F.col("__key"), "left")
    return joined.select(*[F.col(f"`{x}`") for x in df.columns if x != out], F.coalesce(F.col(found), F.lit(default)).alias(out))


def events_in_window(
    index_df: DataFrame,
    events_df: DataFrame,
    key: str,
    index_ts: str,
    event_ts: str,
    lo_hours: float,
    hi_hours: float,
    bucket_hours: float | None = None,
    broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS,
    prune_range: bool = True,
) -> DataFrame:
    """Pairs (index row, event) with equal ``key`` and
    ``index_ts + lo <= event_ts < index_ts + hi`` (half-open window).

    Output: all columns of ``index_df`` and all columns of ``events_df``
    except ``key`` (taken once). Column names of the two sides must not
    clash otherwise.
    """
    width = float(hi_hours - lo_hours)
    if width <= 0:
        raise ValueError("empty window")
    bucket = float(bucket_hours or max(width, 1.0))
    bucket_us = int(bucket * 3_600_000_000)
    lo_c = add_hours(F.col(index_ts), lo_hours)
    hi_c = add_hours(F.col(index_ts), hi_hours)

    idx = (
        index_df.withColumn("__lo", lo_c)
        .withColumn("__hi", hi_c)
        .withColumn(
            "__bucket",
            F.explode(
                F.sequence(
                    F.floor(_epoch_micros(F.col("__lo")) / bucket_us),
                    F.floor((_epoch_micros(F.col("__hi")) - 1) / bucket_us),
                )
            ),
        )
    )
    ev = events_df
    # one small job on the index side: the window range (two scalars that let
    # the scan skip parquet row groups outside every window) and the exact
    # number of (index row, bucket) rows, which decides the broadcast
    span = F.floor((_epoch_micros(hi_c) - 1) / bucket_us) - F.floor(_epoch_micros(lo_c) / bucket_us) + 1
    stats = index_df.agg(F.min(lo_c).alias("a"), F.max(hi_c).alias("b"), F.sum(span).alias("rows")).first()
    if prune_range and stats is not None and stats["a"] is not None:
        ts_type = events_df.schema[event_ts].dataType
        a, b = F.lit(stats["a"]).cast(ts_type), F.lit(stats["b"]).cast(ts_type)
        ev = ev.where((F.col(event_ts) >= a) & (F.col(event_ts) < b))
    ev = ev.withColumn("__bucket", F.floor(_epoch_micros(F.col(event_ts)) / bucket_us))
    if broadcast_rows and (stats["rows"] or 0) <= broadcast_rows:
        idx = F.broadcast(idx)
    joined = ev.join(idx, on=[key, "__bucket"], how="inner").where((F.col(event_ts) >= F.col("__lo")) & (F.col(event_ts) < F.col("__hi")))
    return joined.drop("__bucket", "__lo", "__hi")


# --------------------------------------------------------------------------- as-of
def first_event_after(
    index_df: DataFrame,
    events_df: DataFrame,
    key: str,
    index_ts: str,
    event_ts: str,
    out: str,
    strict: bool = True,
    bucket_hours: float = 24.0,
) -> DataFrame:
    """Forward as-of lookup: for each index row, the first ``event_ts`` of the
    same ``key`` after ``index_ts`` (``>`` when strict, else ``>=``); NULL if none.
    See ``first_events_after``."""
    return first_events_after(index_df, events_df, key, index_ts, event_ts, {out: None}, strict, bucket_hours)


def first_events_after(
    index_df: DataFrame,
    events_df: DataFrame,
    key: str,
    index_ts: str,
    event_ts: str,
    outs: Mapping[str, Column | None],
    strict: bool = True,
    bucket_hours: float = 24.0,
    broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """Several forward as-of lookups in one pass: ``outs`` maps an output
    column to an event condition (``None`` = any event); each output is the
    first matching ``event_ts`` of the same ``key`` after ``index_ts``.

    Exact and linear, no window bound needed:
      1. inside a (key, time bucket) the index rows and events are merged and
         a running ``min`` over the later rows gives the in-bucket answer;
         the index row itself travels through the window (no row ids);
      2. per (key, bucket) the first event time is aggregated (partial agg);
         a running ``min`` over later buckets of the same key gives the answer
         for everything past the bucket. Index rows are reduced to distinct
         (key, bucket) before this step, so its window holds at most two rows
         per non-empty bucket of a key;
      3. the answer is the least of the two.
    A hot key is split over its buckets; ``bucket_hours`` bounds each group.
    All outputs share the scan, the shuffles and the windows.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(index_df.sparkSession)
    bucket_us = int(bucket_hours * 3_600_000_000)
    row_type = index_df.schema
    names = list(outs)
    # the index side is read three times (window input, bucket list, time
    # bound): materialise it once in the reliable checkpoint folder
    idx = index_df.select(
        F.col(key).alias("__key"),
        F.floor(_epoch_micros(F.col(index_ts)) / bucket_us).alias("__b"),
        F.col(index_ts).alias("__t"),
        F.struct(*[F.col(f"`{c}`") for c in index_df.columns]).alias("__row"),
    ).checkpoint(eager=True)
    ev = events_df.where(F.col(event_ts).isNotNull())
    # one small job: the earliest index time (events before it can never be
    # an answer; a static bound that reaches the parquet scan) and the number
    # of distinct index buckets (decides the broadcast semi join below)
    stats = idx.agg(F.min(F.col("__t")).alias("m"), F.count_distinct("__key", "__b").alias("nb")).first()
    first_index = stats["m"]
    if first_index is not None:
        ev = ev.where(F.col(event_ts) >= F.lit(first_index).cast(events_df.schema[event_ts].dataType))
    ev = ev.select(
        F.col(key).alias("__key"),
        F.col(event_ts).alias("__t"),
        *[(F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))).alias(f"__m{i}") for i, cond in enumerate(outs.values())],
    )
    ev = ev.withColumn("__b", F.floor(_epoch_micros(F.col("__t")) / bucket_us))
    match_cols = [f"__m{i}" for i in range(len(names))]
    idx_buckets = idx.select("__key", "__b").distinct()

    # 1. inside the bucket: when the distinct index buckets are proven small,
    #    a broadcast semi join (a map-side filter) keeps events of buckets
    #    without index rows out of the window's shuffle and sort. Otherwise
    #    the semi join would itself shuffle every event, so it is skipped.
    idx_kind, ev_kind = (0, 1) if strict else (1, 0)
    ev_in = ev
    if broadcast_rows and stats["nb"] <= broadcast_rows:
        ev_in = ev.join(F.broadcast(idx_buckets), on=["__key", "__b"], how="left_semi")
    merged = idx.select("__key", "__b", "__t", F.lit(idx_kind).alias("__k"), "__row", *[F.lit(False).alias(m) for m in match_cols]).unionByName(
        ev_in.select("__key", "__b", "__t", F.lit(ev_kind).alias("__k"), F.lit(None).cast(row_type).alias("__row"), *match_cols)
    )
    w_in = Window.partitionBy("__key", "__b").orderBy(F.col("__t").desc(), F.col("__k").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_cols = [F.min(F.when(F.col(m), F.col("__t"))).over(w_in).alias(f"__in{i}") for i, m in enumerate(match_cols)]
    in_bucket = merged.select("__key", "__b", "__row", *in_cols).where(F.col("__row").isNotNull())

    # 2. later buckets
    per_bucket = ev.groupBy("__key", "__b").agg(*[F.min(F.when(F.col(m), F.col("__t"))).alias(f"__bt{i}") for i, m in enumerate(match_cols)])
    ts_type = per_bucket.schema["__bt0"].dataType
    both = idx_buckets.select("__key", "__b", *[F.lit(None).cast(ts_type).alias(f"__bt{i}") for i in range(len(names))], F.lit(0).alias("__k")).unionByName(
        per_bucket.select("__key", "__b", *[f"__bt{i}" for i in range(len(names))], F.lit(1).alias("__k"))
    )
    # a NULL index time has a NULL bucket: it sorts first, so it sees no later bucket
    w_key = Window.partitionBy("__key").orderBy(F.col("__b").desc_nulls_first(), F.col("__k").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = both.select("__key", "__b", "__k", *[F.min(f"__bt{i}").over(w_key).alias(f"__lt{i}") for i in range(len(names))]).where(F.col("__k") == 0).drop("__k")

    res = in_bucket.join(later, on=["__key", "__b"], how="left")
    return res.select("__row.*", *[F.least(F.col(f"__in{i}"), F.col(f"__lt{i}")).alias(n) for i, n in enumerate(names)])


# --------------------------------------------------------------------------- K3
def exposure_flags(
    cohort: DataFrame,
    events: DataFrame,
    unit_id: str,
    key: str,
    index_ts: str,
    event_ts: str,
    category: str,
    exposed: str,
    comparator: str,
    amount: str,
    item: str,
    lo_hours: float = 0.0,
    hi_hours: float = 24.0,
    unit_col: str | None = None,
    unit_value: str | None = None,
    labels: Sequence[str] = ("exposed", "comparator", "neither"),
    names: Mapping[str, str] | None = None,
    broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """One row per cohort unit with exposure flags in ``[index+lo, index+hi)``.

    Columns: ``received_exposed``, ``received_comparator`` (0/1),
    ``total_amount`` (comparator amounts, only rows whose unit equals
    ``unit_value`` when given; 0 when none), ``exposed_count`` (distinct
    exposed items), ``first_exposed_time``, ``treatment_group`` (1 / 0 /
    NULL) and ``treatment_label``. ``names`` renames any of them.
    ``events`` must already carry the ``category`` column (see
    ``functions.categorize``).
    """
    n = {
        "received_exposed": "received_exposed",
        "received_comparator": "received_comparator",
        "total_amount": "total_amount",
        "exposed_count": "exposed_count",
        "first_exposed_time": "first_exposed_time",
        "treatment_group": "treatment_group",
        "treatment_label": "treatment_label",
    }
    n.update(names or {})
    keep = [key, event_ts, category, amount, item] + ([unit_col] if unit_col else [])
    ev = events.select(*dict.fromkeys(keep)).where(F.col(category).isin(exposed, comparator))
    index = cohort.select(*dict.fromkeys([unit_id, key]), F.col(index_ts).alias("__index_ts"))
    pairs = events_in_window(index, ev, key, "__index_ts", event_ts, lo_hours, hi_hours, broadcast_rows=broadcast_rows)

    is_exp = F.col(category) == F.lit(exposed)
    is_cmp = F.col(category) == F.lit(comparator)
    amount_cond = is_cmp if unit_col is None else (is_cmp & (F.col(unit_col) == F.lit(unit_value)))
    per_unit = pairs.groupBy(unit_id).agg(
        F.max(flag(is_exp)).alias("__rx"),
        F.max(flag(is_cmp)).alias("__rc"),
        F.sum(F.when(amount_cond, F.col(amount)).otherwise(F.lit(0))).alias("__amt"),
        # distinct exposed items: bounded by the category's item list, so a
        # set per unit is small; one hash aggregation, no distinct expansion
        F.size(F.collect_set(F.when(is_exp, F.col(item)))).alias("__cnt"),
        F.min(F.when(is_exp, F.col(event_ts))).alias("__first"),
    )
    out = cohort.select(unit_id, *[c for c in cohort.columns if c != unit_id]).join(per_unit, on=unit_id, how="left")
    group, label = assign_arm(F.col("__rx"), F.col("__rc"), labels)
    amount_type = ev.schema[amount].dataType
    return (
        out.withColumn(n["received_exposed"], F.coalesce(F.col("__rx"), F.lit(0)))
        .withColumn(n["received_comparator"], F.coalesce(F.col("__rc"), F.lit(0)))
        .withColumn(n["total_amount"], F.coalesce(F.col("__amt"), F.lit(0).cast(amount_type)))
        .withColumn(n["exposed_count"], F.coalesce(F.col("__cnt"), F.lit(0)))
        .withColumn(n["first_exposed_time"], F.col("__first"))
        .withColumn(n["treatment_group"], group)
        .withColumn(n["treatment_label"], label)
        .drop("__rx", "__rc", "__amt", "__cnt", "__first")
    )


# --------------------------------------------------------------------------- K4 / W2 / A6
def baseline_covariates(
    cohort: DataFrame,
    events: DataFrame,
    unit_id: str,
    key: str,
    index_ts: str,
    event_ts: str,
    item: str,
    value: str,
    items: Mapping[str, object],
    tiebreak: str,
    lo_hours: float = 0.0,
    hi_hours: float = 6.0,
    broadcast_rows: int | None = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """First valid value per listed item in ``[index+lo, index+hi)``, one column per item.

    Valid = not NULL and > 0 (checked before ranking). "First" = earliest
    ``event_ts``, ties broken by ``tiebreak``. One conditional ``min_by`` per
    item in a single aggregation: no sort of the event rows, no pivot shuffle.
    Output: ``unit_id`` + one column per key of ``items`` (units without any
    valid value are absent; left-join onto the cohort).
    """
    wanted = list(items.values())
    ev = events.select(*dict.fromkeys([key, event_ts, item, value, tiebreak])).where(F.col(item).isin(wanted) & F.col(value).isNotNull() & (F.col(value) > 0))
    index = cohort.select(*dict.fromkeys([unit_id, key]), F.col(index_ts).alias("__index_ts"))
    pairs = events_in_window(index, ev, key, "__index_ts", event_ts, lo_hours, hi_hours, broadcast_rows=broadcast_rows)
    order = order_key(pairs, event_ts, tiebreak)
    aggs = []
    for name, code in items.items():
        hit = F.col(item) == F.lit(code)
        aggs.append(F.min_by(F.when(hit, F.col(value)), F.when(hit, order)).alias(name))
    return pairs.groupBy(unit_id).agg(*aggs)


_ID_SHIFT = "9223372036854775808"  # 2^63: moves a signed long id to [0, 2^64)
_ID_SPACE = "100000000000000000000"  # 10^20 > 2^64


def order_key(df: DataFrame, ts: str, tiebreak: str) -> Column:
    """Ordering key for "earliest ``ts``, then lowest ``tiebreak``".

    For a timestamp and an integral id both are packed exactly into one
    DECIMAL(38,0) (wall-clock micros * 10^20 + shifted id): a fixed-width
    key, so ``min_by`` runs as a hash aggregation. Other types fall back to
    a struct key (sort-based aggregation).
    """
    from pyspark.sql import types as T

    ts_type = df.schema[ts].dataType
    tb_type = df.schema[tiebreak].dataType
    if isinstance(ts_type, (T.TimestampType, T.TimestampNTZType)) and isinstance(tb_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        dec = "decimal(38,0)"
        micros = wall_micros(F.col(ts)).cast(dec)
        shifted = F.col(tiebreak).cast(dec) + F.lit(_ID_SHIFT).cast(dec)
        return micros * F.lit(_ID_SPACE).cast(dec) + shifted
    return F.struct(F.col(ts), F.col(tiebreak))


def pivot_first(df: DataFrame, key: str, item: str, value: str, order: Sequence[str], items: Mapping[str, object]) -> DataFrame:
    """Long (key, item, value, order...) -> wide: first value per listed item by ``order``.

    A (timestamp, integral id) order packs into one fixed-width key (hash
    aggregation); other orders use a struct key (sort-based aggregation).
    """
    order = list(order)
    order_struct = order_key(df, order[0], order[1]) if len(order) == 2 else F.struct(*[F.col(o) for o in order])
    aggs = []
    for name, code in items.items():
        hit = F.col(item) == F.lit(code)
        aggs.append(F.min_by(F.when(hit, F.col(value)), F.when(hit, order_struct)).alias(name))
    return df.where(F.col(item).isin(list(items.values()))).groupBy(key).agg(*aggs)


# --------------------------------------------------------------------------- K2
def add_outcome(
    df: DataFrame,
    index_ts: str,
    event_ts: str,
    censor_ts: str,
    horizon_days: int = 28,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Outcome columns from an event time (NULL = no event) and a censoring time.

    * ``outcome_mortality_28d``: event present and boundary days from index
      <= horizon (no lower bound: an event before the index counts).
    * ``time_to_event_days``: boundary days to the event, else to ``censor_ts``.
    * ``event_observed``: event present at any time (not cut at the horizon).
    """
    from ..functions.exprs import boundary_diff

    n = {"outcome": "outcome_mortality_28d", "duration": "time_to_event_days", "event": "event_observed"}
    n.update(names or {})
    days_to_event = boundary_diff("day", F.col(index_ts), F.col(event_ts))
    return (
        df.withColumn(n["outcome"], flag(F.col(event_ts).isNotNull() & (days_to_event <= horizon_days)))
        .withColumn(n["duration"], F.when(F.col(event_ts).isNotNull(), days_to_event).otherwise(boundary_diff("day", F.col(index_ts), F.col(censor_ts))))
        .withColumn(n["event"], flag(F.col(event_ts).isNotNull()))
    )


def administrative_censor(df: DataFrame, duration: str, event: str, horizon: int) -> DataFrame:
    """Cut follow-up at ``horizon``: later events become censored at the horizon."""
    over = F.col(duration) > F.lit(horizon)
    return df.withColumn(event, F.when(over, F.lit(0)).otherwise(F.col(event))).withColumn(duration, F.when(over, F.lit(horizon)).otherwise(F.col(duration)))


# --------------------------------------------------------------------------- K5
def analysis_mart(cohort: DataFrame, treatment: DataFrame, covariates: DataFrame, unit_id: str, group_col: str = "treatment_group") -> DataFrame:
    """cohort ⋈ treatment (inner) ⟕ covariates (left), units with an arm only."""
    t_cols = [c for c in treatment.columns if c not in cohort.columns or c == unit_id]
    c_cols = [c for c in covariates.columns if c not in cohort.columns or c == unit_id]
    return (
        cohort.join(treatment.select(*t_cols), on=unit_id, how="inner")
        .join(covariates.select(*c_cols), on=unit_id, how="left")
        .where(F.col(group_col).isNotNull())
    )


# --------------------------------------------------------------------------- K6
def attrition(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Counts left after each rule, applied cumulatively, in one pass.

    Output: ``step`` (0 = all rows), ``rule``, ``n_remaining``, ``n_removed``.
    A NULL rule result removes the row, as a SQL ``where`` would.
    """
    cum = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("s0")]
    for i, (_, cond) in enumerate(rules, start=1):
        cum = cum & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(cum).alias(f"s{i}"))
    wide = df.agg(*aggs)
    names = ["all rows"] + [r for r, _ in rules]
    stack = ", ".join(f"{i}, '{names[i].replace(chr(39), chr(39) * 2)}', s{i}" for i in range(len(names)))
    long = wide.selectExpr(f"stack({len(names)}, {stack}) as (step, rule, n_remaining)")
    w = Window.orderBy("step")
    return long.withColumn("n_removed", F.coalesce(F.lag("n_remaining").over(w) - F.col("n_remaining"), F.lit(0))).select(
        F.col("step").cast("long"), "rule", F.col("n_remaining").cast("long"), F.col("n_removed").cast("long")
    )
