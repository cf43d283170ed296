"""Column-level helpers: every one returns a Column built from built-in
Spark functions, so it stays inside whole-stage codegen."""

from epiframe.functions.keys import key_equals, norm
from epiframe.functions.numeric import (
    coerce_date, coerce_double, coerce_long, expm1, finite, log1p, pct_label,
    pearson, safe_ratio,
)

__all__ = [
    "norm", "key_equals", "safe_ratio", "coerce_long", "coerce_double", "coerce_date",
    "log1p", "expm1", "finite", "pct_label", "pearson",
]
