"""Scalar Column functions (flags, code sets, boundary date differences, arms)."""

from .exprs import (  # noqa: F401
    add_hours,
    age_at,
    assign_arm,
    band,
    boundary_diff,
    categorize,
    flag,
    flag_codes,
    is_present,
    logit,
    los_days,
    null_tokens,
    to_numeric,
    wall_micros,
)
