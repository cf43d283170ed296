"""Equi-joins of the enrichment path.

Join strategy is left to the planner: dimension and mapping tables are
broadcast automatically when their measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-checks the runtime size
of aggregated sides); larger inputs fall back to a sort-merge join, whose
skewed partitions AQE splits.  No side is force-broadcast on faith.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epiframe.functions.keys import norm


def with_key(df: DataFrame, source: str, key: str = "country_key") -> DataFrame:
    """Add the normalised join key."""
    return df.withColumn(key, norm(source))


def apply_mapping(df: DataFrame, mapping: DataFrame, key: str = "country_key") -> DataFrame:
    """J1 + P7 + P8: left join on the source key, replace the key by the
    mapped one where a mapping exists, drop the helper columns.
    ``mapping`` has (src_key, dim_key), both normalised."""
    m = mapping.select(F.col("src_key").alias("_src"), F.col("dim_key").alias("_dst"))
    joined = df.join(m, F.col(key) == F.col("_src"), "left")
    return joined.withColumn(key, F.coalesce(F.col("_dst"), F.col(key))).drop("_src", "_dst")


def merge_dimension(df: DataFrame, dim: DataFrame, key: str = "country_key",
                    dim_name: str = "country") -> DataFrame:
    """Inner join with the dimension on the normalised key; unmatched
    rows are dropped (``unmatched`` reports them)."""
    d = dim.withColumn("_dim_key", norm(dim_name)).drop(dim_name)
    return df.join(d, F.col(key) == F.col("_dim_key"), "inner").drop("_dim_key")


def unmatched(df: DataFrame, dim: DataFrame, key: str = "country_key",
              dim_name: str = "country") -> DataFrame:
    """Rows whose (mapped) key has no dimension row — the loss J2 hides."""
    d = dim.select(norm(dim_name).alias("_dim_key"))
    return df.join(d, F.col(key) == F.col("_dim_key"), "left_anti")


def with_labels(df: DataFrame, labels: DataFrame, entity: str = "country_region") -> DataFrame:
    """Left join with cluster labels then drop unlabelled rows — an inner join."""
    return df.join(labels, entity, "inner")


def overlay_actuals(forecast: DataFrame, history: DataFrame, keys: list[str],
                    actual: str = "y") -> DataFrame:
    """Forecast rows with the observed value beside them (NULL for the
    future)."""
    return forecast.join(history.select(*keys, F.col(actual)), keys, "left")
