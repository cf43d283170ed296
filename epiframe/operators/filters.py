"""Row predicates."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, functions as F

from epiframe.functions.keys import key_equals
from epiframe.functions.numeric import finite


def for_entity(df: DataFrame, value: str, entity: str = "country_region") -> DataFrame:
    """Rows of one entity, case- and space-insensitive, value bound as a literal."""
    return df.filter(key_equals(entity, value))


def select_entities(df: DataFrame, selection: list[str] | None,
                    entity: str = "country_region") -> DataFrame:
    """P10: keep rows whose entity is in the selection; empty selection = all.
    A literal IN-set at any length (a hash set in the filter, pushed to the
    Parquet reader when the column is stored as-is): no join, no shuffle, and
    the columns stay as they are.  The selection is a driver-side list."""
    if not selection:
        return df
    return df.filter(F.col(entity).isin(list(dict.fromkeys(selection))))


def active_rows(df: DataFrame, value: str = "cases_since_prev_day") -> DataFrame:
    """Value IS NOT NULL AND value > 0."""
    return df.filter(F.col(value).isNotNull() & (F.col(value) > 0))


def in_date_range(df: DataFrame, start: str, end: str, date: str = "date",
                  month_directory: str | None = None) -> DataFrame:
    """Closed range start <= date <= end with literal dates.  On a layout
    in month directories (``warehouse.write_clustered``) name the directory
    column: the equivalent month predicate then prunes whole directories.  No
    column is taken for one by its name."""
    lo_d, hi_d = _dt.date.fromisoformat(start), _dt.date.fromisoformat(end)
    cond = F.col(date).between(F.lit(lo_d), F.lit(hi_d))
    if month_directory:
        cond = cond & F.col(month_directory).between(F.lit(lo_d.replace(day=1)), F.lit(hi_d.replace(day=1)))
    return df.filter(cond)


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """P19 + P20: drop rows where any of ``columns`` is NULL, NaN or +/-inf."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & finite(c).isNotNull()
    return df.filter(keep)
