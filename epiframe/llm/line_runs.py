"""Line de-duplication against levelled sorted runs of line hashes, by DataFrame functions alone.

A run is a table of 128-bit line hashes and the document that holds each line
first, in buckets by hash and sorted within.  A new batch of documents counts
its own lines, anti-joins every run (their side is never shuffled again) and
is added as a run of level 0; ``fanout`` runs of a level are compacted into
one of the next, so a store of N batches keeps about fanout * log(N) runs."""

from __future__ import annotations

import re
import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from epiframe.llm.common import cut
from epiframe.session import work_dir

SPACE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def document(doc_id: Column, text: Column) -> Column:
    """What a row counts as: ordered by id, rows without one last.  Rows equal in
    id and text are one document; rows that share an id, or have none, but
    differ in their texts are documents of their own, ordered by a hash."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64(text).alias("text"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """(doc, pos, h1, h2): every line whose key has ``least`` code points or more."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    each = docs.select(document(F.col(id_col), F.col(text_col)).alias("doc"), F.posexplode(split).alias("pos", "line"))
    keyed = each.select("doc", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keyed.select("doc", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The store: catalog tables ``<name>_<level>_<batch>``, found again by name."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, fanout: int = 4):
        self.spark, self.name, self.fanout = spark, name.lower(), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> dict[int, list[str]]:
        """level -> its tables."""
        found: dict[int, list[str]] = {}
        for t in self.spark.catalog.listTables(pattern=f"{self.name}_*"):
            if m := re.fullmatch(rf"{re.escape(self.name)}_(\d+)_\w+", t.name):
                found.setdefault(int(m[1]), []).append(t.name)
        return found

    def _write(self, run: DataFrame, table: str) -> None:
        (run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", work_dir(self.spark, table))
         .format("parquet").saveAsTable(table))

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _compact(self) -> None:
        """Levels that hold ``fanout`` runs become one run of the next, lowest first."""
        level = 0
        while True:
            runs = self.runs()
            if level > max(runs, default=-1):
                return
            old = runs.get(level, [])
            if len(old) >= self.fanout:
                merged = self.spark.table(old[0])
                for t in old[1:]:
                    merged = merged.unionByName(self.spark.table(t))
                self._write(merged.groupBy(*HASH).agg(F.min("doc").alias("doc")), f"{self.name}_{level + 1}_{uuid.uuid4().hex[:8]}")
                for t in old:
                    self._drop(t)
            level += 1

    def add(self, batch: DataFrame, label: str) -> DataFrame:
        """The rows of ``batch`` (as ``lines`` gives them) that are to go: the key
        is in an earlier run, or the batch's smallest document with it is another.

        A batch that failed half-way may be added again under its label: its own
        run is replaced, and runs are only compacted when the next batch comes."""
        table = f"{self.name}_0_{label}"
        self._drop(table)
        self._compact()
        new = batch.groupBy(*HASH).agg(F.min("doc").alias("doc"))
        for level in self.runs().values():
            for run in level:
                new = new.join(self.spark.table(run), HASH, "left_anti")
        self._write(new, table)
        return batch.join(self.spark.table(table), [*HASH, "doc"], "left_anti")

    def forget(self) -> None:
        """Drop the tables of the store from the catalog (their files stay in the work folder)."""
        for level in self.runs().values():
            for run in level:
                self._drop(run)


def _batch(docs: DataFrame, id_col: str, batches: int) -> Column:
    """The batch of a line (its ``doc``): about equally many ids each, in their
    order; rows without an id are in the last, ids that are not numbers in one."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.NumericType):
        return F.lit(0)
    shares = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(id_col, shares).alias("at")).first()["at"] if shares else None
    above = sum((F.when(F.col("doc.id") > F.lit(b).cast(kind), 1).otherwise(0) for b in bounds or []), F.lit(0))
    return F.when(F.col("doc.none"), F.lit(batches - 1)).otherwise(above)


def _with_mask(rows: DataFrame) -> DataFrame:
    """``rows`` plus mask: a byte per line up to the last one to go, 1 for those of
    ``drops`` (ascending positions), null without any.

    What a lambda refers to is a column that is used twice, so it is computed once
    per row and not per element; a byte is found without reading those before
    it.  So the work grows with the number of lines, not with its square."""
    rows = rows.withColumn("ends", F.when(F.col("drops").isNotNull(), F.concat(F.array(F.lit(-1)), F.col("drops"))))
    marks = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.concat(
        F.repeat(F.lit("0"), F.get("ends", i) - F.get("ends", i - 1) - 1), F.lit("1")))
    return rows.withColumn("mask", F.when(F.col("drops").isNotNull(), F.array_join(marks, "").cast("binary")))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10,
           batches: int = 6, fanout: int = 3) -> DataFrame:
    """All rows of ``docs`` with their columns, n_lines (before dropping),
    n_dropped and kept (the text of the lines that stay, joined by line feeds).

    Lines are split at line feeds (null or empty text: one empty line).  A line
    whose key (see ``line_key``) has ``least`` code points or more and occurs in
    several documents (see ``document``) stays in the smallest of them, there
    every time it occurs, and goes from the others.  The rows are added to a
    store of their own in batches by id, smallest first, so the first document
    to bring a line is the smallest.  Input columns named like the three new
    ones are replaced; an empty table gives an empty one."""
    spark = docs.sparkSession
    path = work_dir(spark, "lines")
    (lines(docs, id_col, text_col, least).withColumn("batch", _batch(docs, id_col, batches))
     .write.partitionBy("batch").parquet(path))
    stored = spark.read.schema(T.StructType([
        T.StructField("doc", T.StructType([T.StructField("none", T.BooleanType()), T.StructField("id", docs.schema[id_col].dataType),
                                           T.StructField("text", T.LongType())])),
        T.StructField("pos", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
        T.StructField("batch", T.IntegerType())])).parquet(path)
    store = LineRuns(spark, f"lines{uuid.uuid4().hex[:10]}", fanout=fanout)
    gone = []
    for b in range(batches):
        gone.append(cut(store.add(stored.where(F.col("batch") == b).drop("batch"), f"b{b}"), "dropped"))
    store.forget()
    drops = reduce(DataFrame.unionByName, gone).groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("drops"))

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"),
                       document(F.col(id_col), F.col(text_col)).alias("doc"))
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    done = _with_mask(rows.join(drops, "doc", "left").withColumn("split", split))
    stay = F.filter("split", lambda _, i: F.substring(F.col("mask"), i + 1, F.lit(1)) != F.lit(b"1"))
    kept = F.when(F.col("mask").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    new = {"n_lines": F.size("split").cast("long"), "n_dropped": F.coalesce(F.size("drops"), F.lit(0)).cast("long"), "kept": kept}
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *[c.alias(k) for k, c in new.items()])
