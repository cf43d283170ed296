"""Clustered layout on several keys at once, kept up as rows arrive.

A linear sort prunes by its first key only.  Here every key is cut into 2^bits
stretches with equally many rows (exact ranks, a few boundary values each), and
a row's cell is the number whose bits are those of its stretches in turn
(Z-order): rows that are near in all keys share a cell.  A condition on any one of k keys
leaves one stretch, which is a 2^-bits share of the cells.

New rows are appended as files of their cells, by the boundaries the table began
with.  Files of one cell overlap, so cells that have gathered too many are
merged.  A manifest lists the live files with their cell and the range of each
key in them; readers see whole versions of it, one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from epiframe.operators.ranking import grouped_counts
from epiframe.sources.manifest import read_manifest, write_manifest

CELL = "_cell"


def boundaries(df: DataFrame, key: str, bits: int) -> list:
    """Up to 2^bits - 1 values that cut the rows of ``df`` by ``key`` into stretches of
    equal size (a frequent value is never cut; NULL rows count in the first)."""
    n = 1 << bits
    counts = grouped_counts(df.select(F.lit(0).alias("_g"), F.col(key).alias("_v")), "_g", "_v")
    # the value that holds rank i * total / n, for every i
    first, last = F.ceil(F.col("before") * n / F.col("total")), F.ceil((F.col("before") + F.col("n")) * n / F.col("total")) - 1
    held = F.greatest(first, F.lit(1)) <= F.least(last, F.lit(n - 1))
    return sorted(r["_v"] for r in counts.where(held).select("_v").distinct().collect())  # at most n - 1


def stretch(key: Column, bounds: list) -> Column:
    """How many boundaries are at or below the value; 0 for NULL."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)), F.lit(0))


def cell(stretches: list[Column], bits: int) -> Column:
    """The Z-order number: the highest bit of each, then the next of each."""
    out = F.lit(0)
    for bit in range(bits - 1, -1, -1):
        for s in stretches:
            out = out * 2 + F.shiftright(s, bit).bitwiseAND(1)
    return out.cast("int")


def coordinates(number: int, keys: int, bits: int) -> list[int]:
    """The stretches of a cell."""
    out = [0] * keys
    for i in range(bits * keys):
        out[i % keys] = out[i % keys] * 2 + (number >> (bits * keys - 1 - i) & 1)
    return out


class CurvedTable:
    """A table of ``schema`` under ``path``, clustered on ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        ranges = [T.StructField(f"{side}{i}", schema[k].dataType) for i, k in enumerate(keys) for side in ("lo", "hi")]
        # a key's range is NULL where all its values in the file are
        self.files_schema = T.StructType([T.StructField("segment", T.StringType()), T.StructField(CELL, T.IntegerType()),
                                          T.StructField("file", T.StringType()), T.StructField("rows", T.LongType()), *ranges])
        self.bounds_schema = T.StructType([T.StructField("bits", T.IntegerType()), T.StructField("place", T.IntegerType()),
                                           *[T.StructField(f"b{i}", schema[k].dataType) for i, k in enumerate(keys)]])

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], bits: int = 3) -> "CurvedTable":
        """Lay out ``df`` as a new table; ``bits`` gives 2^(bits * keys) cells."""
        table = cls(df.sparkSession, path, df.schema, keys)
        bounds = [boundaries(df, k, bits) for k in keys]
        size = max(1, *map(len, bounds))
        rows = [(bits, i, *[b[i] if i < len(b) else None for b in bounds]) for i in range(size)]
        table.spark.createDataFrame(rows, table.bounds_schema).coalesce(1).write.parquet(f"{table.path}/bounds")
        return table.append(df)

    def _bounds(self) -> tuple[int, list[list]]:
        rows = self.spark.read.schema(self.bounds_schema).parquet(f"{self.path}/bounds").orderBy("place").collect()
        return rows[0]["bits"], [[r[f"b{i}"] for r in rows if r[f"b{i}"] is not None] for i in range(len(self.keys))]

    def _manifest(self) -> tuple[int, list[tuple]]:
        version, rows = read_manifest(self.spark, f"{self.path}/manifest", self.files_schema)
        return version, [tuple(r)[:len(self.files_schema)] for r in rows if r["file"]]

    def _commit(self, version: int, rows: list[tuple]) -> None:
        empty = [(None,) * len(self.files_schema)]
        write_manifest(self.spark, f"{self.path}/manifest", self.files_schema, version, rows or empty)

    def _write(self, df: DataFrame) -> list[tuple]:
        """Write rows as files of their cells; their manifest rows."""
        bits, bounds = self._bounds()
        placed = df.withColumn(CELL, cell([stretch(F.col(k), b) for k, b in zip(self.keys, bounds)], bits))
        segment = uuid.uuid4().hex
        to = f"{self.path}/segments/{segment}"
        # a cell is one partition, or several where it is large
        placed.hint("rebalance", CELL).sortWithinPartitions(CELL, *self.keys).write.partitionBy(CELL).parquet(to)
        full = T.StructType([*self.schema.fields, T.StructField(CELL, T.IntegerType())])
        ranges = [f(k).alias(f"{side}{i}") for i, k in enumerate(self.keys) for side, f in (("lo", F.min), ("hi", F.max))]
        listed = self.spark.read.schema(full).parquet(to).groupBy(CELL, F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ranges)
        return [(segment, *r) for r in listed.collect()]

    def append(self, df: DataFrame) -> "CurvedTable":
        """Add rows of the table's schema."""
        version, rows = self._manifest()
        self._commit(version + 1, rows + self._write(df.select(*self.schema.names)))
        return self

    def merge(self, most: int = 1) -> list[int]:
        """Rewrite the cells that have more than ``most`` files (files that were one
        write's parts of a large cell count as one); the cells rewritten."""
        version, rows = self._manifest()
        writes: dict[int, set[str]] = {}
        for segment, number, *_ in rows:
            writes.setdefault(number, set()).add(segment)
        due = {number for number, segments in writes.items() if len(segments) > most}
        if due:
            old = [r[2] for r in rows if r[1] in due]
            self._commit(version + 1, [r for r in rows if r[1] not in due] + self._write(self._read(old)))
        return sorted(due)

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def files(self, **ranges: tuple) -> list[str]:
        """The live files that may hold rows with every key of ``ranges`` in its (least,
        greatest), both included, None for no bound."""
        bits, bounds = self._bounds()
        out = []
        for row in self._manifest()[1]:
            at = coordinates(row[1], len(self.keys), bits)
            keep = True
            for name, (lo, hi) in ranges.items():
                i = self.keys.index(name)
                first, last = row[4 + 2 * i], row[5 + 2 * i]
                in_cell = ((lo is None or sum(b <= lo for b in bounds[i]) <= at[i]) and (hi is None or at[i] <= sum(b <= hi for b in bounds[i])))
                keep = keep and in_cell and first is not None and (lo is None or lo <= last) and (hi is None or first <= hi)
            if keep:
                out.append(row[2])
        return out

    def read(self, **ranges: tuple) -> DataFrame:
        """The rows with every key of ``ranges`` in its (least, greatest); all without."""
        df = self._read(self.files(**ranges))
        for name, (lo, hi) in ranges.items():
            if lo is not None:
                df = df.where(F.col(name) >= F.lit(lo))
            if hi is not None:
                df = df.where(F.col(name) <= F.lit(hi))
        return df
