"""Comment ingestion as a stream — JSON files in, the S6 projection,
append to the Parquet store with a checkpoint (exactly-once file sink).

``start_checked_ingest`` writes to a ``CommentLog`` instead: what a client sends
twice is stored once, and lines that are no comment are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from epiframe.plans.comment_log import CommentLog
from epiframe.plans.comments import BUCKET, prepare, read_store
from epiframe.schemas import COMMENT_IN


def start_ingest(spark: SparkSession, source_dir: str, store_path: str, checkpoint: str,
                 bytes_per_trigger: str | None = None, every: str | None = None) -> StreamingQuery:
    """Start ingestion, all new files or about ``bytes_per_trigger`` of them
    in a micro-batch; ``every`` keeps it running on a processing-time
    trigger, ``None`` ingests what is there now and stops."""
    reader = spark.readStream.schema(COMMENT_IN)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    stream = reader.json(source_dir)
    writer = (prepare(stream).writeStream.format("parquet").outputMode("append").partitionBy(BUCKET)
              .option("path", store_path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def ingest(spark: SparkSession, source_dir: str, store_path: str, checkpoint: str,
           bytes_per_trigger: str | None = None) -> DataFrame:
    """Ingest everything available now; returns the store read back."""
    start_ingest(spark, source_dir, store_path, checkpoint, bytes_per_trigger).awaitTermination()
    return read_store(spark, store_path)


CLIENT_ID = "client_id"
_BAD = "_unreadable"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line, reason, the comment's columns and its client id) of JSON lines: reason is
    NULL for a comment, else why the line is none: ``unreadable`` JSON or a wrong
    type, or the first ``missing`` column of those a comment must have."""
    fields = [T.StructField(f.name, f.dataType) for f in COMMENT_IN.fields] + [T.StructField(CLIENT_ID, T.StringType())]
    read = F.from_json("value", T.StructType([*fields, T.StructField(_BAD, T.StringType())]), {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"})
    out = lines.select(F.col("value").alias("line"), read.alias("r"))
    must = [f.name for f in COMMENT_IN.fields if not f.nullable] + [CLIENT_ID]
    missing = F.coalesce(*[F.when(F.col(f"r.{c}").isNull(), F.lit(f"missing {c}")) for c in must])
    reason = F.when(F.col("r").isNull() | F.col(f"r.{_BAD}").isNotNull(), F.lit("unreadable")).otherwise(missing)
    return out.select("line", reason.alias("reason"), *[F.col(f"r.{f.name}").alias(f.name) for f in fields])


def start_checked_ingest(spark: SparkSession, source_dir: str, log_path: str, rejects_path: str, checkpoint: str,
                         within: str = "1 day", bytes_per_trigger: str | None = None,
                         every: str | None = None) -> list[StreamingQuery]:
    """Start the two streams of a checked ingest of JSON lines; both read every line.

    The first drops comments whose client id came before in the last ``within`` of
    arrival time, which bounds the ids it remembers (a comment is never too late,
    as arrival counts), and appends each micro-batch to the log under its number,
    so a replayed one changes nothing.  The second keeps the other lines, with the
    reason, in Parquet files (exactly once)."""
    reader = spark.readStream
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    parsed = parse_lines(reader.text(source_dir)).withColumn("arrived", F.current_timestamp())
    good = parsed.where("reason is null").withWatermark("arrived", within).dropDuplicatesWithinWatermark([CLIENT_ID])
    log = CommentLog(spark, log_path)
    writers = [good.writeStream.foreachBatch(lambda batch, number: log.append(batch, number) and None).option("checkpointLocation", f"{checkpoint}/log"),
               parsed.where("reason is not null").select("line", "reason", "arrived").writeStream.format("parquet")
               .option("path", rejects_path).option("checkpointLocation", f"{checkpoint}/rejects")]
    return [(w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start() for w in writers]


def checked_ingest(spark: SparkSession, source_dir: str, log_path: str, rejects_path: str, checkpoint: str,
                   within: str = "1 day") -> tuple[CommentLog, DataFrame]:
    """Ingest the lines there are; the log, and the rejected lines (line, reason, arrived)."""
    for q in start_checked_ingest(spark, source_dir, log_path, rejects_path, checkpoint, within):
        q.awaitTermination()
    return CommentLog(spark, log_path), spark.read.schema("line string, reason string, arrived timestamp").parquet(rejects_path)
