"""Column expressions (all built-in, JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zscore(x: Column | str, avg: Column | str, sd: Column | str) -> Column:
    """(x - avg) / sd; NULL where sd is 0 or NULL (the reference yields NaN)."""
    return F.try_divide(_c(x) - _c(avg), _c(sd))


def weighted_impact(pct: Column | str, avg_pct: Column | str, attempts: Column | str) -> Column:
    """Volume-weighted impact (pct - avg(pct)) * attempts."""
    return (_c(pct) - _c(avg_pct)) * _c(attempts)


def max_abs_normalize(x: Column | str, mx: Column | str, mn: Column | str) -> Column:
    """x / max(|max|, |min|); NULL when both bounds are 0."""
    return F.try_divide(_c(x), F.greatest(F.abs(_c(mx)), F.abs(_c(mn))))


def row_sum(cols: list[Column | str]) -> Column:
    """Sum across columns of one row; NULL if any term is NULL (as NaN spreads)."""
    out = None
    for c in cols:
        out = _c(c) if out is None else out + _c(c)
    return out


def nan_to_null(x: Column | str) -> Column:
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def blank_to_zero(x: Column | str, to: str = "double", fill: float | None = 0.0) -> Column:
    """Text field to a number: blank -> ``fill`` (0 as in the reference, or
    NULL with ``fill=None``); text that does not parse stays NULL."""
    c = F.trim(_c(x))
    parsed = F.nullif(c, F.lit("")).try_cast(to)
    if fill is None:
        return parsed
    return F.when(c.isNull() | (c == ""), F.lit(fill).cast(to)).otherwise(parsed)


def clean_name(x: Column | str) -> Column:
    """Strip the hall-of-fame '*' and a trailing '\\id' suffix from a name."""
    no_star = F.regexp_replace(_c(x), r"\*", "")
    return F.regexp_replace(no_star, r"\\\w+$", "")
