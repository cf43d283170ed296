"""A small table that says which files or directories of a store are current.

It has two halves: version v is written into half v % 2, replacing version v - 2
at commit, so a reader finds the last whole version while the next one is
written, and a writer that repeats version v still finds v - 1.  One writer at a
time; the number of rows is bounded by the store's own structure."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Row, SparkSession, types as T

VERSION, HALF = "_version", "_half"


def read_manifest(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> tuple[int, list[Row]]:
    """(version, rows) of the newest version, or of the newest before one; (-1, []) if there is none."""
    full = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(HALF, T.IntegerType())])
    try:
        found = spark.read.schema(full).parquet(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    versions = [r[VERSION] for r in found if before is None or r[VERSION] < before]
    if not versions:
        return -1, []
    return max(versions), [r for r in found if r[VERSION] == max(versions)]


def write_manifest(spark: SparkSession, path: str, schema: T.StructType, version: int, rows: list[tuple]) -> None:
    """Make ``rows`` (one at least) the content of ``version``."""
    full = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(HALF, T.IntegerType())])
    (spark.createDataFrame([(*r, version, version % 2) for r in rows], full).coalesce(1)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(HALF).parquet(path))
