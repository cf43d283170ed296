"""Comment store of sorted segments with a key index.

An append writes one segment: its comments range-partitioned and sorted by key,
so every file covers a narrow key range, with a Parquet Bloom filter on the key,
and beside it how often each key occurs.  A manifest lists the files of the live
segments with their first and last key.  A lookup opens only files whose range
holds a wanted key (and the reader skips those whose Bloom filter does not);
counts come from the kept counts, not from a second scan.

``fanout`` segments of a tier are merged into one of the next (size-tiered), so
after n appends about fanout * log(n) segments are live, each with one file for a
key that is not larger than a file.  One writer at a time; readers see whole
versions of the manifest.  Files of merged segments stay on disk until
``forget_merged`` removes them, so that slow readers still find them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from epiframe.functions.keys import norm
from epiframe.plans.comments import BUCKET, prepare
from epiframe.schemas import COMMENT_STORED
from epiframe.sources.manifest import read_manifest, write_manifest

KEY = "country_key"
#: A row per file, with its segment's tier (0 for an append) and the last stream batch
#: applied to the store.  A store without rows has one row without a file.
FILES = T.StructType([T.StructField("segment", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("file", T.StringType()),
                      T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("rows", T.LongType()),
                      T.StructField("applied", T.LongType())])
COUNTS = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("n", T.LongType())])


def _holds(file, keys: list[str]) -> bool:
    """Whether one of ``keys`` may be in a file of the manifest (without a key: no)."""
    return file["first"] is not None and any(file["first"] <= k <= file["last"] for k in keys)


class CommentLog:
    """A store under ``path``."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 8):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    def files(self) -> list:
        """The rows of the manifest: the files of the live segments."""
        return [r for r in read_manifest(self.spark, f"{self.path}/manifest", FILES)[1] if r["file"]]

    def _write(self, rows: DataFrame, tier: int, per_file: int | None) -> list[tuple]:
        """Write one segment; its manifest rows."""
        segment = uuid.uuid4().hex
        to = f"{self.path}/segments/{segment}"
        # the id keeps a hot key from being one range
        ranged = rows.repartitionByRange(KEY, "comment_id").sortWithinPartitions(KEY, "timestamp", "comment_id")
        writer = ranged.write.option(f"parquet.bloom.filter.enabled#{KEY}", "true")
        (writer.option("maxRecordsPerFile", per_file) if per_file else writer).parquet(to)
        stored = self.spark.read.schema(COMMENT_STORED).parquet(to)
        stored.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions(KEY).write.parquet(f"{self.path}/counts/{segment}")
        listed = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(KEY).alias("first"), F.max(KEY).alias("last"), F.count(F.lit(1)).alias("rows"))
        return [(segment, tier, r["file"], r["first"], r["last"], r["rows"]) for r in listed.collect()]

    def _manifest(self) -> tuple[int, list[tuple], int]:
        """(version, rows of live files, last stream batch applied)."""
        version, rows = read_manifest(self.spark, f"{self.path}/manifest", FILES)
        return version, [tuple(r)[:6] for r in rows if r["file"]], max((r["applied"] for r in rows), default=-1)

    def _commit(self, version: int, rows: list[tuple], applied: int) -> None:
        write_manifest(self.spark, f"{self.path}/manifest", FILES, version, [(*r, applied) for r in rows] or [(None, 0, None, None, None, 0, applied)])

    def append(self, df: DataFrame, batch: int | None = None, per_file: int | None = None) -> "CommentLog":
        """Append comments (normalised key, stamp, generated id) as a segment, then
        merge what is due.  With ``batch`` (a stream's number) a batch applied
        before is left out."""
        version, rows, applied = self._manifest()
        if batch is not None and batch <= applied:
            return self  # a stream's batch that is replayed
        rows, applied = rows + self._write(prepare(df).drop(BUCKET), 0, per_file), applied if batch is None else batch
        self._commit(version := version + 1, rows, applied)
        while (merged := self._merged(rows, per_file)) is not None:
            self._commit(version := version + 1, rows := merged, applied)
        return self

    def _merged(self, rows: list[tuple], per_file: int | None) -> list[tuple] | None:
        """The rows after the segments of the lowest tier that has ``fanout`` of them are
        merged into one of the next; None if no tier has."""
        tiers: dict[int, set[str]] = {}
        for segment, tier, *_ in rows:
            tiers.setdefault(tier, set()).add(segment)
        due = min((t for t, s in tiers.items() if len(s) >= self.fanout), default=None)
        if due is None:
            return None
        old = [r[2] for r in rows if r[0] in tiers[due]]
        return [r for r in rows if r[0] not in tiers[due]] + self._write(self._read(old), due + 1, per_file)

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], COMMENT_STORED)
        return self.spark.read.schema(COMMENT_STORED).parquet(*files)

    def read(self) -> DataFrame:
        """All comments."""
        return self._read([r["file"] for r in self.files()])

    def files_of(self, keys: list[str]) -> list[str]:
        """The files whose key range holds one of the normalised ``keys``."""
        return [r["file"] for r in self.files() if _holds(r, keys)]

    def _normalised(self, keys: list[str]) -> list[str]:
        one = self.spark.range(1).select(*[norm(F.lit(k)).alias(f"k{i}") for i, k in enumerate(keys)]).first()
        return sorted({k for k in one if k is not None})

    def counts(self, keys: list[str]) -> DataFrame:
        """(key, n) of the normalised ``keys``, from the counts kept with the segments."""
        live = sorted({r["segment"] for r in self.files() if _holds(r, keys)})
        if not live:
            return self.spark.createDataFrame([], COUNTS)
        kept = self.spark.read.schema(COUNTS).parquet(*[f"{self.path}/counts/{s}" for s in live])
        return kept.where(F.col(KEY).isin(keys)).groupBy(KEY).agg(F.sum("n").alias("n"))

    def for_key(self, key: str) -> DataFrame:
        """S7 + A16: the comments of one key with their number beside each row."""
        keys = self._normalised([key])
        n = self.counts(keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
        return self._read(self.files_of(keys)).where(F.col(KEY).isin(keys)).withColumn("count", n)

    def for_keys(self, keys: list[str]) -> DataFrame:
        """The comments of several keys, ordered by key, time and id."""
        wanted = self._normalised(keys) if keys else []
        return self._read(self.files_of(wanted)).where(F.col(KEY).isin(wanted)).orderBy(KEY, "timestamp", "comment_id")

    def forget_merged(self) -> list[str]:
        """Delete the files of segments the manifest's two versions no longer list; their names."""
        version, live = read_manifest(self.spark, f"{self.path}/manifest", FILES)
        _, earlier = read_manifest(self.spark, f"{self.path}/manifest", FILES, before=version)
        kept = {r["segment"] for r in [*live, *earlier]}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for folder in ("segments", "counts"):
            if fs.exists(path(f"{self.path}/{folder}")):
                for status in fs.listStatus(path(f"{self.path}/{folder}")):
                    if status.getPath().getName() not in kept:
                        fs.delete(status.getPath(), True)
                        gone.append(f"{folder}/{status.getPath().getName()}")
        return sorted(gone)
