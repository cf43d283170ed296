"""Aggregations, sorts and top-k over an entity-by-day panel.

Column names are parameters; defaults follow the panel schema.  Every
grouped aggregate is a hash aggregate with a map-side partial step, so a hot
entity never concentrates raw rows in one task.  Top-k is ``orderBy().limit``
which Spark plans as ``TakeOrderedAndProject`` (each task keeps k rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from epiframe.functions.keys import key_equals
from epiframe.operators.filters import active_rows, in_date_range


def _sum_long(c: str) -> Column:
    return F.sum(F.col(c)).cast("bigint")


def country_totals(df: DataFrame, entity: str = "country_region", cases: str = "cases",
                   deaths: str = "deaths") -> DataFrame:
    """A1: entity -> total_cases, total_deaths.  All-null groups stay NULL."""
    return df.groupBy(entity).agg(_sum_long(cases).alias("total_cases"),
                                  _sum_long(deaths).alias("total_deaths"))


def country_totals_for(df: DataFrame, country: str, entity: str = "country_region",
                       cases: str = "cases", deaths: str = "deaths") -> DataFrame:
    """A2 + P9: totals of one entity, matched case- and space-insensitively.
    Catalyst moves the filter below the aggregate to right after the scan of
    the entity column (being a function of the column, it is evaluated
    there rather than pushed into the Parquet reader)."""
    return country_totals(df.filter(key_equals(entity, country)), entity, cases, deaths)


def country_totals_positive(df: DataFrame, entity: str = "country_region", cases: str = "cases",
                            deaths: str = "deaths") -> DataFrame:
    """A3: totals with HAVING total_cases > 0."""
    return country_totals(df, entity, cases, deaths).filter(F.col("total_cases") > 0)


def row_count(df: DataFrame) -> DataFrame:
    """A4: one row, total_rows."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def rows_per_entity(df: DataFrame, entity: str = "country_region") -> DataFrame:
    """A5 + O1: entity -> total_records, largest first (ties by entity)."""
    return (df.groupBy(entity).agg(F.count(F.lit(1)).alias("total_records"))
            .orderBy(F.desc_nulls_last("total_records"), F.asc_nulls_last(entity)))


def date_range(df: DataFrame, date: str = "date") -> DataFrame:
    """start_date, end_date."""
    return df.agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"))


def value_stats(df: DataFrame, value: str = "cases_since_prev_day",
                entity: str = "country_region") -> DataFrame:
    """Entity -> avg/max/min of value over all rows, by average desc."""
    return (df.groupBy(entity)
            .agg(F.avg(value).alias("avg_new_cases"), F.max(value).alias("max_new_cases"),
                 F.min(value).alias("min_new_cases"))
            .orderBy(F.desc_nulls_last("avg_new_cases"), F.asc_nulls_last(entity)))


def value_stats_active(df: DataFrame, value: str = "cases_since_prev_day",
                       entity: str = "country_region") -> DataFrame:
    """A7 over active rows only (value > 0).  Not the same numbers as A7."""
    return value_stats(active_rows(df, value), value, entity)


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """total_rows plus one non-null count per column, in one pass.
    ``columns`` maps output names to source columns via ``name=src`` or plain names."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for spec in columns:
        out, _, src = spec.partition("=")
        aggs.append(F.count(F.col(src or out)).alias(out if src else f"{out}_not_null"))
    return df.agg(*aggs)


def daily_sum(df: DataFrame, value: str = "cases_since_prev_day", date: str = "date") -> DataFrame:
    """A10 + O2: date -> total_new_cases over all rows, in date order."""
    return (df.groupBy(date).agg(_sum_long(value).alias("total_new_cases"))
            .orderBy(F.asc_nulls_last(date)))


def daily_sum_active(df: DataFrame, value: str = "cases_since_prev_day", date: str = "date") -> DataFrame:
    """A10 over active rows only (dates without active rows disappear)."""
    return daily_sum(active_rows(df, value), value, date)


def daily_sum_window(df: DataFrame, start: str, end: str, value: str = "cases_since_prev_day",
                     date: str = "date", month_directory: str | None = None) -> DataFrame:
    """A11 restricted to a closed date window.  On a stored table the
    range predicate reaches the Parquet reader (row-group skipping, and
    directory pruning on the month layout); on a panel derived with a lag
    window it is applied after the window, which needs the earlier rows."""
    return daily_sum_active(in_date_range(df, start, end, date, month_directory), value, date)


def top_k(df: DataFrame, by: str, k: int, entity: str = "country_region") -> DataFrame:
    """K largest by ``by`` (NULLs last), ties broken by entity."""
    return df.orderBy(F.desc_nulls_last(by), F.asc_nulls_last(entity)).limit(k)


def top_deaths(df: DataFrame, k: int = 10, entity: str = "country_region",
               deaths: str = "deaths") -> DataFrame:
    """Top-k entities by summed deaths."""
    totals = df.groupBy(entity).agg(_sum_long(deaths).alias("total_deaths"))
    return top_k(totals, "total_deaths", k, entity)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values, sorted."""
    return df.select(column).dropna().distinct().orderBy(column)


def axis_bound(df: DataFrame, column: str, factor: float = 1.2, fallback: float = 1.0,
               alias: str = "axis_max") -> DataFrame:
    """max(column) * factor, or the fallback when every value is NULL."""
    return df.agg(F.coalesce(F.max(F.col(column).cast("double")) * F.lit(factor),
                             F.lit(fallback)).alias(alias))


def scalar_row(one_row: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery.  Every field
    read from it refers to the same subquery, which AQE executes once
    (``ReusedSubquery``) — the way to attach global statistics to every row
    without a cross join or a single-partition window."""
    return one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns])).scalar()


def with_count(df: DataFrame, alias: str = "count", per: str | None = None) -> DataFrame:
    """The result cardinality beside every row.

    Default: a scalar subquery (one global aggregate; no window over a
    single partition), safe for any size.  ``per=<entity>``: the count of
    each entity's rows via a window partitioned by the entity — one pass,
    no second computation of ``df`` — for series whose groups are bounded
    (an entity's dates in a panel)."""
    if per is not None:
        return df.withColumn(alias, F.count(F.lit(1)).over(Window.partitionBy(per)))
    n = df.select(F.count(F.lit(1))).scalar()
    return df.withColumn(alias, n)


def preview(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)
