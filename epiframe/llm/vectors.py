"""Which vectors take part in searches and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
