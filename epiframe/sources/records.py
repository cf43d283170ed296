"""Rows <-> JSON records.

``to_records`` keeps one JSON document per row, so the export stays
distributed; a response's ``count`` travels as a column beside each row
(see ``operators.aggregates.with_count``) instead of nesting a whole result
into one array value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def to_records(df: DataFrame, alias: str = "record") -> DataFrame:
    """Every field of every row, NULL fields as ``null``."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(alias))


def parse_records(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Parse a column of JSON record strings back into typed columns."""
    parsed = df.select(F.from_json(F.col(column), schema).alias("_r"))
    return parsed.select("_r.*")


def parse_record_array(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Parse a JSON array of records (one string per row) and explode it."""
    arr = F.from_json(F.col(column), T.ArrayType(schema))
    return df.select(F.explode(arr).alias("_r")).select("_r.*")
