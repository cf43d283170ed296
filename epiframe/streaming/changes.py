"""T1 for base tables whose rows change: aggregates kept current under inserts,
updates and deletions.

A change row holds the base row before and after it (``before`` is NULL for an
insert, ``after`` for a deletion).  It becomes signed rows, -1 and +1, and a
micro-batch becomes signed sums and counts per group, aggregated map-side.
Sums and counts merge by addition, so batches may come in any order.  For the
least and greatest value a view keeps how often each value occurs per group:
deleting the last occurrence of the greatest uncovers the next one.

The state lies in directories by a hash of the group.  A micro-batch reads and
writes only the buckets its groups fall in (nothing else is touched), each into
the one of its two slots that is not current; a manifest of one row per bucket
then makes the new slots current.  The manifest too has two slots, so a batch
that is replayed after a failure finds the state from before it, and writes the
same result again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from epiframe.session import materialise
from epiframe.sources.manifest import read_manifest, write_manifest

SIGN, BUCKET, SLOT, EPOCH = "_sign", "_bucket", "_slot", "_epoch"
SUM, VALUES, ROWS = "_sum", "_values", "_rows"


@dataclass(frozen=True)
class View:
    """An aggregate of ``value`` by ``keys`` over the base rows that ``where`` selects.

    ``extremes`` keeps counts per (keys, value), for the least and greatest value.
    Values are whole numbers or decimals: floating sums would not cancel."""
    keys: list[str]
    value: str
    where: Callable[[DataFrame], DataFrame] = field(default=lambda rows: rows)
    extremes: bool = False

    @property
    def groups(self) -> list[str]:
        return [*self.keys, self.value] if self.extremes else list(self.keys)


def change_schema(base: T.StructType) -> T.StructType:
    """The schema of change rows over a base table."""
    return T.StructType([T.StructField("before", base), T.StructField("after", base)])


def inserts(rows: DataFrame) -> DataFrame:
    """Change rows that insert ``rows``."""
    return rows.select(F.lit(None).cast(rows.schema).alias("before"), F.struct(*rows.columns).alias("after"))


def deletions(rows: DataFrame) -> DataFrame:
    """Change rows that delete ``rows``."""
    return rows.select(F.struct(*rows.columns).alias("before"), F.lit(None).cast(rows.schema).alias("after"))


def updates(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Change rows that give the columns ``new`` of ``rows`` new values."""
    after = [new[c].cast(rows.schema[c].dataType).alias(c) if c in new else F.col(c) for c in rows.columns]
    return rows.select(F.struct(*rows.columns).alias("before"), F.struct(*after).alias("after"))


def signed(changes: DataFrame) -> DataFrame:
    """The base rows that changes take away (sign -1) and bring (sign +1)."""
    sides = F.array(F.struct(F.lit(-1).alias(SIGN), F.col("before").alias("row")), F.struct(F.lit(1).alias(SIGN), F.col("after").alias("row")))
    each = changes.select(F.inline(sides)).where(F.col("row").isNotNull())
    return each.select("row.*", SIGN)


def delta(view: View, changes: DataFrame, buckets: int) -> DataFrame:
    """What a batch of changes adds to the state: (bucket, groups, sum, values, rows),
    one row per group whose counts or sum it changes."""
    rows = view.where(signed(changes))
    kind = rows.schema[view.value].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{view.value} is {kind.simpleString()}: sums of signed rows need whole numbers or decimals")
    present = F.col(view.value).isNotNull()
    out = rows.groupBy(*view.groups).agg(
        F.coalesce(F.sum(F.col(view.value) * F.col(SIGN)), F.lit(0)).cast(_sum_type(kind)).alias(SUM),
        F.coalesce(F.sum(F.when(present, F.col(SIGN))), F.lit(0)).cast("long").alias(VALUES), F.sum(SIGN).cast("long").alias(ROWS))
    bucket = F.pmod(F.xxhash64(*view.keys), F.lit(buckets)).cast("int").alias(BUCKET)
    return out.where(f"{SUM} <> 0 or {VALUES} <> 0 or {ROWS} <> 0").select(bucket, *view.groups, SUM, VALUES, ROWS)


def _sum_type(kind: T.DataType) -> T.DataType:
    return T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.LongType()


#: A row per bucket in use: its slot and the epoch it was written in; bucket -1 holds
#: the number of buckets as its slot.
MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("written", T.LongType())])


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[dict[int, tuple[int, int]], int]:
    """(bucket -> (slot, epoch it was written in), number of buckets), the newest or
    the newest before an epoch; ({}, 0) if there is none."""
    _, rows = read_manifest(spark, f"{path}/manifest", MANIFEST, before)
    return ({r["bucket"]: (r["slot"], r["written"]) for r in rows if r["bucket"] >= 0},
            next((r["slot"] for r in rows if r["bucket"] < 0), 0))


def _state(spark: SparkSession, path: str, schema: T.StructType, current: dict[int, tuple[int, int]], buckets: list[int] | None = None) -> DataFrame:
    """The current rows of the state, of all buckets or some: only their directories are opened."""
    wanted = {b: v for b, v in current.items() if buckets is None or b in buckets}
    if not wanted:
        return spark.createDataFrame([], schema)
    condition = F.lit(False)
    for slot in (0, 1):
        for written in sorted({e for s, e in wanted.values() if s == slot}):
            own = [b for b, v in wanted.items() if v == (slot, written)]
            condition = condition | ((F.col(SLOT) == slot) & F.col(BUCKET).isin(own) & (F.col(EPOCH) == written))
    full = T.StructType([*schema.fields, T.StructField(EPOCH, T.LongType()), T.StructField(SLOT, T.IntegerType())])
    return spark.read.schema(full).parquet(f"{path}/state").where(condition).select(*schema.names)


def apply_batch(view: View, changes: DataFrame, path: str, epoch: int, buckets: int = 64) -> list[int]:
    """Bring the state under ``path`` from the epoch before to ``epoch``; the buckets written.

    ``buckets`` counts when the state begins; later the number stored with it
    holds.  A batch that changes no group still gets its manifest."""
    spark = changes.sparkSession
    current, known = _manifest(spark, path, before=epoch)
    buckets = known or buckets
    added = materialise(delta(view, changes, buckets), "delta")
    touched = sorted(r[0] for r in added.select(BUCKET).distinct().collect())  # at most one per bucket
    if touched:
        old = _state(spark, path, added.schema, current, touched)
        merged = (old.unionByName(added).groupBy(BUCKET, *view.groups)
                  .agg(*[F.sum(c).cast(added.schema[c].dataType).alias(c) for c in (SUM, VALUES, ROWS)])
                  .where(f"{SUM} <> 0 or {VALUES} <> 0 or {ROWS} <> 0"))
        turned = [b for b in touched if current.get(b, (1, 0))[0] == 0]
        slot = F.when(F.col(BUCKET).isin(turned), 1).otherwise(0) if turned else F.lit(0)
        (merged.withColumn(EPOCH, F.lit(epoch).cast("long")).withColumn(SLOT, slot).hint("rebalance", BUCKET)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, SLOT).parquet(f"{path}/state"))
        current = current | {b: (int(b in turned), epoch) for b in touched}
    write_manifest(spark, f"{path}/manifest", MANIFEST, epoch, [(b, *v) for b, v in current.items()] + [(-1, buckets, epoch)])
    return touched


def state_schema(view: View, base: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(BUCKET, T.IntegerType()), *[T.StructField(c, base[c].dataType) for c in view.groups],
                         T.StructField(SUM, _sum_type(base[view.value].dataType)), T.StructField(VALUES, T.LongType()), T.StructField(ROWS, T.LongType())])


def read_view(spark: SparkSession, view: View, base: T.StructType, path: str) -> DataFrame:
    """The view as of the newest manifest: (keys, total, n) and with ``extremes``
    (max, min).  total is NULL where a group has no value, n counts its values;
    groups without rows are gone.  Empty before the first batch."""
    state = _state(spark, path, state_schema(view, base), _manifest(spark, path)[0])
    if view.extremes:
        there = F.when(F.col(VALUES) > 0, F.col(view.value))
        state = state.groupBy(*view.keys).agg(F.sum(SUM).alias(SUM), F.sum(VALUES).alias(VALUES), F.sum(ROWS).alias(ROWS),
                                              F.max(there).alias("max"), F.min(there).alias("min"))
    total = F.when(F.col(VALUES) > 0, F.col(SUM)).cast(_sum_type(base[view.value].dataType))
    return state.where(F.col(ROWS) > 0).select(*view.keys, total.alias("total"), F.col(VALUES).alias("n"), *(["max", "min"] if view.extremes else []))


def start_changes(spark: SparkSession, view: View, base: T.StructType, source_dir: str, path: str, checkpoint: str,
                  buckets: int = 64, files_per_trigger: int | None = None, every: str | None = None) -> StreamingQuery:
    """Keep ``view`` current from change files (Parquet, ``change_schema(base)``) as
    they arrive, or with ``every=None`` from those there now.  The stream has no
    state of its own: what it merges into lies under ``path``."""
    reader = spark.readStream.schema(change_schema(base))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    writer = (reader.parquet(source_dir).writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, epoch: apply_batch(view, batch, path, epoch, buckets) and None))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_changes(spark: SparkSession, view: View, base: T.StructType, source_dir: str, path: str, checkpoint: str,
                buckets: int = 64, files_per_trigger: int | None = None) -> DataFrame:
    """Apply the change files there are and return the view read back."""
    start_changes(spark, view, base, source_dir, path, checkpoint, buckets, files_per_trigger).awaitTermination()
    return read_view(spark, view, base, path)
