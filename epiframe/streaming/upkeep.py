"""Incremental upkeep of the materialised aggregates.

A file stream with a fixed schema feeds a grouped aggregate in complete
mode.  State is one row per group key (dates or entities), so it is bounded
by the key space, not by the rows streamed.

The sink is double-buffered so readers see a complete snapshot (where the file
system renames directories atomically):
micro-batch ``e`` writes its full result, stamped with ``e``, into partition
slot ``e % 2`` with dynamic partition overwrite (only that slot is
replaced, at commit).  ``read_current`` returns the rows of the highest
epoch present.  While one slot is being rewritten, the other still holds the
previous complete result.  A batch that is replayed after a failure
rewrites the same slot with the same result, so the sink is idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


EPOCH, SLOT = "_epoch", "_slot"


def start_complete_aggregate(spark: SparkSession, source_dir: str, schema: StructType,
                             body: Callable[[DataFrame], DataFrame], sink_path: str,
                             checkpoint: str, bytes_per_trigger: str | None = None,
                             every: str | None = None) -> StreamingQuery:
    """Start the upkeep job.  A micro-batch takes all new files, or about
    ``bytes_per_trigger`` (e.g. ``"64g"``) of them.  ``every`` (e.g. ``"1 minute"``) keeps it running
    on a processing-time trigger as files arrive; ``None`` processes what is
    available now and stops."""
    reader = spark.readStream.schema(schema)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    stream = reader.parquet(source_dir)

    def replace(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn(EPOCH, F.lit(epoch_id).cast("bigint")).withColumn(SLOT, F.lit(epoch_id % 2))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SLOT)
         .parquet(sink_path))

    writer = (body(stream).writeStream.outputMode("complete").foreachBatch(replace)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_complete_aggregate(spark: SparkSession, source_dir: str, schema: StructType,
                           body: Callable[[DataFrame], DataFrame], sink_path: str,
                           checkpoint: str, bytes_per_trigger: str | None = None) -> DataFrame:
    """Process everything available in ``source_dir`` (trigger availableNow)
    and return the sink read back: the newest snapshot, also when nothing new
    arrived.  Empty, with the aggregate's schema, only if none was ever written."""
    q = start_complete_aggregate(spark, source_dir, schema, body, sink_path, checkpoint, bytes_per_trigger)
    q.awaitTermination()
    try:
        return read_current(spark, sink_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        out_schema = body(spark.readStream.schema(schema).parquet(source_dir)).schema
        return spark.createDataFrame([], out_schema)


def read_current(spark: SparkSession, sink_path: str) -> DataFrame:
    """The newest complete snapshot of a double-buffered aggregate sink."""
    snap = spark.read.parquet(sink_path)
    latest = snap.agg(F.max(EPOCH)).scalar()
    return snap.filter(F.col(EPOCH) == latest).drop(EPOCH, SLOT)
