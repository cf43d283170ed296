"""Comment store: append, keyed lookup, fan-out, multi-key fetch.

The store is an append-only Parquet table in directories by a hash of the key,
so a lookup opens only its keys' directories.  Keys are normalised on write
(lower + strip), stamped with the current UTC time and given a random id.
``comment_log`` is the store for many appends: sorted segments, merged as they
become many, with an index of keys and kept counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from epiframe.functions.keys import norm
from epiframe.operators.aggregates import with_count
from epiframe.schemas import COMMENT_STORED

STORED_COLUMNS = [f.name for f in COMMENT_STORED.fields]
BUCKET, BUCKETS = "bucket", 64


def bucket_of(key):
    """The directory of a normalised key.  For a literal key the planner folds
    it to a constant, which prunes directories."""
    return (F.crc32(key) % BUCKETS).cast("int")


def prepare(df: DataFrame) -> DataFrame:
    """S6 projection: normalised key, UTC stamp (P24), generated id, directory."""
    return df.select(
        norm("country_key").alias("country_key"), F.col("comment_text"), F.col("user"),
        F.col("source").cast("string").alias("source"),
        F.col("additional_notes").cast("string").alias("additional_notes"),
        F.current_timestamp().alias("timestamp"),
        F.expr("uuid()").alias("comment_id"), bucket_of(norm("country_key")).alias(BUCKET))


def add_comments(df: DataFrame, store_path: str) -> DataFrame:
    """Append comments; returns the store read back.  Rows are dealt by directory
    first (a large one over several tasks), so an append writes few files each."""
    prepare(df).hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(store_path)
    return read_store(df.sparkSession, store_path)


def read_store(spark, store_path: str) -> DataFrame:
    """The stored columns and the directory column."""
    return spark.read.schema(T.StructType([*COMMENT_STORED.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(store_path)


def comments_for_key(store: DataFrame, key: str) -> DataFrame:
    """S7 + A16: the comments of one key with their count beside each row."""
    wanted = norm(F.lit(key))
    found = store.filter((F.col(BUCKET) == bucket_of(wanted)) & (F.col("country_key") == wanted))
    return with_count(found.drop(BUCKET))


def fan_out(df: DataFrame, countries: list[str]) -> DataFrame:
    """One copy of each comment per selected country (key = the country)."""
    if not countries:
        return df.limit(0)
    return (df.drop("country_key")
            .withColumn("country_key", F.explode(F.array(*[F.lit(c) for c in countries]))))


def comments_for_keys(store: DataFrame, keys: list[str]) -> DataFrame:
    """Comments of several keys, ordered by key then time.  The unique id
    ends the sort key: one append stamps all its rows with the same time, so
    without it a hot key would be one unsplittable range of ties."""
    wanted = [norm(F.lit(k)) for k in keys]
    return (store.filter(F.col(BUCKET).isin([bucket_of(k) for k in wanted]) & F.col("country_key").isin(wanted)).drop(BUCKET)
            .orderBy("country_key", "timestamp", "comment_id"))
