"""Tables, layout and materialised aggregates.

Copies are written as Parquet under a caller-given location (the shared
checkpoint folder by default) and optionally registered in the catalog as
external tables.  Databases are created if missing — never dropped and
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from epiframe.operators.filters import active_rows

PRUNED_COLUMNS = ["date", "country_region", "cases_since_prev_day", "deaths", "population"]


def create_database(spark: SparkSession, name: str, location: str) -> str:
    """CREATE DATABASE IF NOT EXISTS, at an explicit location."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{location}'")
    return name


def use_database(spark: SparkSession, name: str) -> None:
    """Select the current database."""
    spark.catalog.setCurrentDatabase(name)


def save_table(df: DataFrame, path: str, name: str | None = None, mode: str = "overwrite",
               partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` (optionally register ``name``) and
    return the table read back, so downstream plans start from the files.  A
    table of that name is replaced (``CREATE OR REPLACE``): only its catalog
    entry goes, its files are external."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    spark = df.sparkSession
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path=path, source="parquet")
        if partition_by:
            # the catalog tracks partitions of an external table: register
            # the directories just written, or SQL would see no rows
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.read.parquet(path)


def table_copy(df: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """Full copy (CTAS ``SELECT *``)."""
    return save_table(df, path, name)


def pruned_copy(df: DataFrame, path: str, name: str | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """Copy of the columns downstream queries read."""
    return save_table(df.select(*(columns or PRUNED_COLUMNS)), path, name)


def active_copy(df: DataFrame, path: str, name: str | None = None,
                value: str = "cases_since_prev_day") -> DataFrame:
    """Copy of the active rows (value > 0)."""
    return save_table(active_rows(df, value), path, name)


MONTH = "month"


def write_clustered(df: DataFrame, path: str, keys: list[str] | None = None,
                    name: str | None = None, files: int | None = None,
                    month_of: str | None = "date") -> DataFrame:
    """Clustered layout.  Range-partition on the keys and sort within
    each file, so every file (and row group) covers a narrow key range and a
    date predicate skips the rest via Parquet min/max statistics.  With
    ``month_of`` the files are also laid out in ``month=`` directories (the
    first day of the month of that date column), which a date-range query
    prunes without opening any footer (``filters.in_date_range`` with
    ``month_directory`` adds the month predicate); the table read back has that
    directory column too.  ``month_of=None`` keeps the table's own columns.  Without an explicit ``files`` count AQE sizes the
    partitions from the data; a hot key range is split across files because
    the sort keys continue past the first one."""
    keys = keys or ["date", "country_region"]
    if month_of:
        df = df.withColumn(MONTH, F.trunc(F.col(month_of), "month"))
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    laid_out = ranged.sortWithinPartitions(*keys)
    return save_table(laid_out, path, name, partition_by=[MONTH] if month_of else None)


# --- materialised aggregates (bodies shared with the streaming upkeep) -----------

def daily_new_body(active: DataFrame, value: str = "cases_since_prev_day",
                   date: str = "date") -> DataFrame:
    """S14 body: date -> total_new_cases over active rows."""
    return active.groupBy(date).agg(F.sum(value).cast("bigint").alias("total_new_cases"))


def deaths_body(pruned: DataFrame, entity: str = "country_region", deaths: str = "deaths") -> DataFrame:
    """S15 body: entity -> total_deaths."""
    return pruned.groupBy(entity).agg(F.sum(deaths).cast("bigint").alias("total_deaths"))


def new_stats_state(active: DataFrame, value: str = "cases_since_prev_day",
                    entity: str = "country_region") -> DataFrame:
    """S16 stored state: sum, count, min, max per entity — mergeable, so it can
    be maintained incrementally."""
    return active.groupBy(entity).agg(
        F.sum(value).cast("bigint").alias("sum_new_cases"), F.count(value).alias("n_new_cases"),
        F.max(value).alias("max_new_cases"), F.min(value).alias("min_new_cases"))


def new_stats_read(state: DataFrame, entity: str = "country_region") -> DataFrame:
    """S16 exposed view: avg = sum / count."""
    return state.select(entity, F.try_divide(F.col("sum_new_cases").cast("double"),
                                             F.col("n_new_cases").cast("double")).alias("avg_new_cases"),
                        "max_new_cases", "min_new_cases")


def save_view(body: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """Store an aggregate as a table and return it read back."""
    return save_table(body, path, name)


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """SHOW TABLES IN database."""
    return spark.sql(f"SHOW TABLES IN `{database}`")


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """DESCRIBE TABLE -> (col_name, data_type, comment)."""
    return spark.sql(f"DESCRIBE TABLE {name}")


def build(panel: DataFrame, root: str, database: str | None = None) -> dict[str, DataFrame]:
    """The warehouse build, in order — full copy (S10), pruned copy
    laid out clustered by (date, country) with its own five columns (S13),
    active rows (S12) from that layout, and the three materialised
    aggregates (S14-S16).  Each table is written under ``root`` (and
    registered in ``database`` when given); returns them read back."""
    def name(t: str) -> str | None:
        return f"{database}.{t}" if database else None

    full = table_copy(panel, f"{root}/panel_full", name("panel_full"))
    pruned = write_clustered(full.select(*PRUNED_COLUMNS), f"{root}/panel_pruned",
                             name=name("panel_pruned"), month_of=None)
    active = active_copy(pruned, f"{root}/panel_active", name("panel_active"))
    return {
        "panel_full": full,
        "panel_pruned": pruned,
        "panel_active": active,
        "agg_daily_new_cases": save_view(daily_new_body(active), f"{root}/agg_daily_new_cases",
                                          name("agg_daily_new_cases")),
        "agg_total_deaths": save_view(deaths_body(pruned), f"{root}/agg_total_deaths", name("agg_total_deaths")),
        "agg_new_case_stats": save_view(new_stats_state(active), f"{root}/agg_new_case_stats",
                                          name("agg_new_case_stats")),
    }
