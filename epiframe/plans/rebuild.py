"""The warehouse build that rewrites only the months that changed.

The rows of every month are summed up in a content hash that does not depend on
their order.  A build compares these hashes with those of the last one and
writes the months that differ: in the copies, in the daily aggregate, and in the
per-month parts of the aggregates by entity, which are merged on reading.  Each
month of a table has two slots; a manifest of one row per month says which
one is current, so a build that fails half-way changes nothing for readers, and
months that are gone or empty leave no old rows behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from epiframe.operators.filters import active_rows
from epiframe.plans.warehouse import PRUNED_COLUMNS
from epiframe.sources.manifest import read_manifest, write_manifest

MONTH, SLOT, BUILT = "_month", "_slot", "_built"
NEW, ENTITY = "cases_since_prev_day", "country_region"
MONTHS = T.StructType([T.StructField("month", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("written", T.LongType()),
                       T.StructField("rows", T.LongType()), T.StructField("h1", T.DecimalType(38, 0)), T.StructField("h2", T.DecimalType(38, 0))])


def month_of(date: Column) -> Column:
    """The month's name; rows without a date are a month of their own."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


def month_hashes(df: DataFrame, date: str = "date") -> DataFrame:
    """(month, rows, h1, h2): the number of rows and the sums of two 64-bit hashes of
    them, equal for equal rows in any order and, but for a chance of 2^-128, only then."""
    cells = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    return df.groupBy(month_of(F.col(date)).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.xxhash64(F.lit(i), *cells).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)])


#: table -> (what the rows of a panel become, by month; how the parts of all months are read).
TABLES: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]] = {
    "panel_full": (lambda p: p, lambda parts: parts),
    "panel_pruned": (lambda p: p.select(MONTH, *PRUNED_COLUMNS), lambda parts: parts),
    "panel_active": (lambda p: active_rows(p.select(MONTH, *PRUNED_COLUMNS), NEW), lambda parts: parts),
    "agg_daily_new_cases": (
        lambda p: active_rows(p, NEW).groupBy(MONTH, "date").agg(F.sum(NEW).cast("bigint").alias("total_new_cases")), lambda parts: parts),
    "agg_total_deaths": (
        lambda p: p.groupBy(MONTH, ENTITY).agg(F.sum("deaths").cast("bigint").alias("total_deaths")),
        lambda parts: parts.groupBy(ENTITY).agg(F.sum("total_deaths").cast("bigint").alias("total_deaths"))),
    "agg_new_case_stats": (
        lambda p: active_rows(p, NEW).groupBy(MONTH, ENTITY).agg(
            F.sum(NEW).cast("bigint").alias("sum_new_cases"), F.count(NEW).alias("n_new_cases"), F.max(NEW).alias("max_new_cases"), F.min(NEW).alias("min_new_cases")),
        lambda parts: parts.groupBy(ENTITY).agg(
            F.sum("sum_new_cases").cast("bigint").alias("sum_new_cases"), F.sum("n_new_cases").cast("bigint").alias("n_new_cases"),
            F.max("max_new_cases").alias("max_new_cases"), F.min("min_new_cases").alias("min_new_cases"))),
}


def _months(spark: SparkSession, root: str) -> tuple[int, dict[str, tuple]]:
    """(number of the last build, month -> (slot, build that wrote it, rows, h1, h2))."""
    build, rows = read_manifest(spark, f"{root}/months", MONTHS)
    return build, {r["month"]: (r["slot"], r["written"], r["rows"], r["h1"], r["h2"]) for r in rows if r["month"] is not None}


def rebuild(panel: DataFrame, root: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Bring the tables under ``root`` to ``panel``; (the tables, the months written).

    ``panel`` is read twice, once for the hashes and once for the months that differ:
    it should be a stored table.  The first build writes all months."""
    spark = panel.sparkSession
    last, known = _months(spark, root)
    build = last + 1
    now = {r["month"]: (r["rows"], r["h1"], r["h2"]) for r in month_hashes(panel).collect()}  # one row per month
    changed = sorted(m for m, content in now.items() if m not in known or known[m][2:] != content)
    months = {m: known[m] for m in now if m not in changed} | {m: (1 - known[m][0] if m in known else 0, build, *now[m]) for m in changed}
    if changed:
        turned = [m for m in changed if months[m][0] == 1]
        rows = panel.withColumn(MONTH, month_of(F.col("date"))).where(F.col(MONTH).isin(changed))
        for name, (body, _) in TABLES.items():
            slot = F.when(F.col(MONTH).isin(turned), 1).otherwise(0) if turned else F.lit(0)
            (body(rows).withColumn(SLOT, slot).withColumn(BUILT, F.lit(build).cast("long")).hint("rebalance", MONTH).sortWithinPartitions(MONTH)
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if last >= 0 else "static")
             .partitionBy(MONTH, SLOT).parquet(f"{root}/{name}"))
    if changed or set(known) != set(now) or last < 0:
        write_manifest(spark, f"{root}/months", MONTHS, build, [(m, *v) for m, v in months.items()] or [(None,) * len(MONTHS)])
    return read_tables(panel, root), changed


def read_tables(panel: DataFrame, root: str) -> dict[str, DataFrame]:
    """The tables of the last build; ``panel`` only gives the schema."""
    spark = panel.sparkSession
    _, months = _months(spark, root)
    out = {}
    for name, (body, merge) in TABLES.items():
        schema = body(panel.withColumn(MONTH, month_of(F.col("date")))).schema
        full = T.StructType([*schema.fields, T.StructField(SLOT, T.IntegerType()), T.StructField(BUILT, T.LongType())])
        if not months:
            out[name] = merge(spark.createDataFrame([], schema)).drop(MONTH)
            continue
        current = F.lit(False)
        for slot, written in sorted({v[:2] for v in months.values()}):
            own = [m for m, v in months.items() if v[:2] == (slot, written)]
            current = current | ((F.col(SLOT) == slot) & F.col(MONTH).isin(own) & (F.col(BUILT) == written))
        out[name] = merge(spark.read.schema(full).parquet(f"{root}/{name}").where(current).drop(SLOT, BUILT)).drop(MONTH)
    return out
