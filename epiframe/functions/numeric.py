"""Null-safe numeric expressions.

Division by zero or by null yields NULL (``try_divide``) instead of the
ANSI error; bad strings coerce to NULL (``try_cast``).  NaN and +/-inf never
reach an ordered column: ``finite`` maps them to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num, den, scale: float | None = None) -> Column:
    """num / den (times scale); NULL when den is 0 or null."""
    r = F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
    return r * F.lit(float(scale)) if scale is not None else r


def coerce_long(c) -> Column:
    """A whole number; other numbers (7.5, 1e6) lose their fraction, what is no number is NULL."""
    return F.coalesce(_col(c).try_cast("bigint"), _col(c).try_cast("double").try_cast("bigint"))


def coerce_double(c) -> Column:
    return _col(c).try_cast("double")


def coerce_date(c) -> Column:
    return _col(c).try_cast("date")


def log1p(c) -> Column:
    """ln(1 + x); NULL for x <= -1 (Spark returns NULL there)."""
    return F.log1p(_col(c))


def expm1(c) -> Column:
    return F.expm1(_col(c))


def finite(c) -> Column:
    """c when it is a finite number, else NULL (drops NaN and +/-inf)."""
    x = _col(c).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def pct_label(c) -> Column:
    """Two-decimal percent label, e.g. 12.34%; NULL for NULL."""
    return F.when(_col(c).isNotNull(), F.format_string("%.2f%%", _col(c)))


def pearson(x, y) -> Column:
    """Pearson correlation over rows where both are non-null; NULL when either
    side is constant (built-in ``corr`` raises DIVIDE_BY_ZERO there under ANSI)."""
    xs, ys = _col(x), _col(y)
    both = xs.isNotNull() & ys.isNotNull()
    px, py = F.when(both, xs), F.when(both, ys)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
