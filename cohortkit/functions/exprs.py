"""Column -> Column helpers (all JVM-side built-ins, no UDFs).

Each helper returns a Spark ``Column`` so it stays inside whole-stage
codegen and composes with ``select`` / ``withColumn`` / ``where``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 integer flag; a NULL condition gives 0 (SQL ``case when`` semantics)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def is_present(c: ColumnOrName) -> Column:
    """1 when the value is present (e.g. any recorded death date), else 0."""
    return flag(_c(c).isNotNull())


def flag_codes(code: ColumnOrName, version: ColumnOrName, sets: Mapping[object, Iterable[str]], normalise: bool = False) -> Column:
    """1 when ``code`` is in the code list of its ``version``.

    ``sets`` maps a version value to its code list. With ``normalise`` the
    dots are removed from both the data and the listed codes, so dotted and
    undotted spellings match each other.
    """
    code_c = _c(code)
    if normalise:
        code_c = F.regexp_replace(code_c, r"\.", "")
    cond = None
    for ver, codes in sets.items():
        codes = [c.replace(".", "") for c in codes] if normalise else list(codes)
        term = (_c(version) == F.lit(ver)) & code_c.isin(sorted(set(codes)))
        cond = term if cond is None else (cond | term)
    return flag(cond if cond is not None else F.lit(False))


def categorize(key: ColumnOrName, mapping: Mapping[str, Iterable[object]], default: str = "other") -> Column:
    """Map a key to a category name; keys not listed get ``default``.

    The first category whose list contains the key wins (``case when`` order).
    """
    expr = None
    for category, keys in mapping.items():
        cond = _c(key).isin(list(keys))
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def wall_micros(ts: ColumnOrName) -> Column:
    """Microseconds since 1970-01-01 00:00 of the wall-clock reading of ``ts``.

    Built from the date and time fields, so a TIMESTAMP_NTZ gives the same
    number in any session time zone (no cast through the session zone, no
    DST shift).
    """
    t = _c(ts)
    days = F.unix_date(F.to_date(t)).cast("long")
    secs = (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("long")
    return days * F.lit(86_400_000_000) + F.hour(t).cast("long") * F.lit(3_600_000_000) + F.minute(t).cast("long") * F.lit(60_000_000) + secs


_epoch_micros = wall_micros


def boundary_diff(unit: str, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Number of ``unit`` boundaries crossed from ``start`` to ``end``.

    ``hour``: 00:59 -> 04:01 is 4, not the 3 full hours Spark's
    ``timestampdiff`` gives. ``day``: 23:59 -> 00:01 is 1 (calendar days).
    """
    unit = unit.lower()
    if unit == "day":
        return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))
    sizes = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}
    if unit not in sizes:
        raise ValueError(f"unsupported unit {unit!r}")
    size = F.lit(sizes[unit])
    diff = F.floor(_epoch_micros(end) / size) - F.floor(_epoch_micros(start) / size)
    return diff.cast("long")


def los_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Length of stay in days = boundary hours / 24 (as double)."""
    return (boundary_diff("hour", start, end) / F.lit(24.0)).cast("double")


def add_hours(ts: ColumnOrName, hours: float | int | Column) -> Column:
    """``ts + n hours``; TIMESTAMP_NTZ stays TIMESTAMP_NTZ."""
    if isinstance(hours, Column):
        return _c(ts) + F.make_dt_interval(F.lit(0), hours.cast("int"))
    whole = int(hours)
    if whole == hours:
        return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(whole))
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600.0))


def age_at(anchor_age: ColumnOrName, admit_time: ColumnOrName, anchor_year: ColumnOrName) -> Column:
    """Age at admission = anchor age + (admission year - anchor year).

    ``admit_time`` may be a string; unparsable values give NULL.
    """
    ts = _c(admit_time)
    year = F.year(F.try_to_timestamp(ts.cast("string")))
    return _c(anchor_age) + (year - _c(anchor_year))


def assign_arm(exposed: ColumnOrName, comparator: ColumnOrName, labels: Sequence[str] = ("exposed", "comparator", "neither")) -> tuple[Column, Column]:
    """Three-way arm: exposed -> 1, comparator only -> 0, neither -> NULL.

    Returns ``(group, label)``. Both flags are coalesced to 0 first.
    """
    e = F.coalesce(_c(exposed), F.lit(0))
    c = F.coalesce(_c(comparator), F.lit(0))
    group = F.when(e == 1, F.lit(1)).when((e == 0) & (c == 1), F.lit(0)).otherwise(F.lit(None).cast("int"))
    label = F.when(e == 1, F.lit(labels[0])).when((e == 0) & (c == 1), F.lit(labels[1])).otherwise(F.lit(labels[2]))
    return group, label


def to_numeric(c: ColumnOrName) -> Column:
    """Numeric coercion: bad values become NULL instead of failing (ANSI mode)."""
    return _c(c).try_cast("double")


def logit(p: ColumnOrName, eps: float = 1e-12) -> Column:
    """log(p / (1 - p)) with p clipped to [eps, 1 - eps]."""
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.log(q / (F.lit(1.0) - q))


def band(x: ColumnOrName, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Label by threshold: ``labels[i]`` for ``cuts[i-1] <= x < cuts[i]``.

    ``len(labels) == len(cuts) + 1``; NULL input gives NULL.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one more label than cuts")
    expr = None
    for cut, label in zip(cuts, labels):
        cond = _c(x) < F.lit(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    last = F.when(_c(x).isNotNull(), F.lit(labels[-1]))
    return last if expr is None else expr.when(_c(x).isNotNull(), F.lit(labels[-1]))


#: Spellings of a missing value in raw text files.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def null_tokens(c: ColumnOrName, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Turn the usual missing-value spellings of a raw string column into NULL."""
    return F.when(_c(c).isin(list(tokens)), F.lit(None).cast("string")).otherwise(_c(c))
