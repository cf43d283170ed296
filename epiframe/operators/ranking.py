"""Exact global positions and ranks without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task.
Instead: range-partition on the order keys (sampled bounds, balanced), store
the rows with their partition number, take running sums inside each
partition, then add the totals of all earlier partitions.  The numbers must be
stored: two plans over the same range exchange may sample different bounds, so
rows and totals both read the files.  The offsets table has one row per
partition — bounded by the partition count, never by the data — so
broadcasting it is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from epiframe.session import materialise


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_sum_before(df: DataFrame, order: list, weight, name: str,
                      partitions: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over all rows strictly before each row
    in the total order ``order`` (keys should be unique)."""
    cols = [_as_col(c) for c in order]
    weighted = df.withColumn("_w", _as_col(weight))
    # without a given number AQE merges small partitions
    ranged = weighted.repartitionByRange(partitions, *cols) if partitions else weighted.repartitionByRange(*cols)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    stored = materialise(ranged, "ranks")
    inside = Window.partitionBy("_pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumn("_before", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    totals = stored.groupBy("_pid").agg(F.sum("_w").alias("_tot"))
    offsets = totals.select(
        "_pid", F.coalesce(F.sum("_tot").over(Window.orderBy("_pid")
                                              .rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_before"))
            .drop("_pid", "_w", "_before", "_off"))


def global_row_number(df: DataFrame, order: list, name: str = "row_index",
                      partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in the total order."""
    out = prefix_sum_before(df, order, F.lit(1).cast("bigint"), name, partitions)
    return out.withColumn(name, F.col(name).cast("bigint"))


def grouped_counts(long: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, before, total) for long-format input — e.g. many
    columns unpivoted to (column, value): how often a non-null value occurs in
    its group, how many of the group's rows are smaller, and how many there
    are.  Counts per (group, value), one global prefix sum over (group, value),
    minus the rows of all earlier groups.  The per-group table has one row per
    group (a column of a profile), so its window and broadcast are bounded by
    the number of groups."""
    counts = (long.filter(F.col(value).isNotNull()).groupBy(group, value)
              .agg(F.count(F.lit(1)).alias("n")))
    counts = prefix_sum_before(counts, [group, value], "n", "before")
    totals = counts.groupBy(group).agg(F.sum("n").cast("bigint").alias("total"), F.min("before").alias("_first"))
    return (counts.join(F.broadcast(totals), group)
            .select(group, value, "n", (F.col("before") - F.col("_first")).cast("bigint").alias("before"), "total"))


def grouped_average_ranks(long: DataFrame, group: str, value: str, name: str = "rank") -> DataFrame:
    """(group, value, average rank of value within its group)."""
    counts = grouped_counts(long, group, value)
    return counts.select(group, value, (F.col("before") + (F.col("n") + F.lit(1)) / F.lit(2.0)).alias(name))


def row_average_ranks(long: DataFrame, group: str, value: str, row: str, name: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    """(group, row, average rank of the row's value within its group), a row per row
    of ``long``; (group, row) is unique and values are not NULL.

    Rows are range-partitioned by (group, value, row), so even a value that most
    rows share is spread over partitions, and stored.  Inside a partition a
    window counts the smaller and the equal rows.  Only the first and the last
    value of a partition can go on in another: their counts are merged in a
    table of at most two rows per partition, whose size bounds the broadcast.
    No join has a value of the data as its key on the rows' side but that one."""
    ranged = long.select(group, value, row)
    ranged = ranged.repartitionByRange(partitions, group, value, row) if partitions else ranged.repartitionByRange(group, value, row)
    stored = materialise(ranged.withColumn("_pid", F.spark_partition_id()), "ranks")
    place = F.struct(F.col(group).alias("g"), F.col(value).alias("v"))
    ends = stored.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"), F.max(place).alias("_last"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = materialise(ends.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "rank_ends")
    ties = (stored.join(F.broadcast(ends), "_pid").groupBy("_pid", "_n", "_off", "_first", "_last")
            .agg(F.count_if(place == F.col("_first")).alias("_nf"), F.count_if(place == F.col("_last")).alias("_nl")))
    first = F.struct(F.col("_first").alias("at"), F.col("_nf").alias("n"), F.col("_off").alias("start"))
    last = F.struct(F.col("_last").alias("at"), F.col("_nl").alias("n"), (F.col("_off") + F.col("_n") - F.col("_nl")).alias("start"))
    edges = ties.select(F.inline(F.when(F.col("_first") == F.col("_last"), F.array(first)).otherwise(F.array(first, last))))
    edges = edges.groupBy("at").agg(F.sum("n").alias("_total"), F.min("start").alias("_start")).select(
        F.col("at.g").alias(group), F.col("at.v").alias(value), "_total", "_start")
    # rows of earlier groups: one row per group
    groups = stored.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    groups = groups.select(group, F.coalesce(F.sum("_rows").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"))

    inside = Window.partitionBy("_pid").orderBy(group, value)
    counted = stored.select(group, value, row, "_pid", (F.rank().over(inside) - 1).alias("_before"),
                            F.count(F.lit(1)).over(Window.partitionBy("_pid", group, value)).alias("_equal"))
    ranked = (counted.join(F.broadcast(ends.select("_pid", "_off")), "_pid").join(F.broadcast(edges), [group, value], "left")
              .join(F.broadcast(groups), group))
    start, total = F.coalesce("_start", F.col("_off") + F.col("_before")), F.coalesce("_total", "_equal")
    return ranked.select(group, row, (start - F.col("_skip") + (total + F.lit(1)) / F.lit(2.0)).alias(name))


def grouped_quantiles(long: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """(group, one column per quantile): the value at rank ceil(p * n) of its
    group, exact at any size."""
    counts = grouped_counts(long, group, value)
    at = {name: F.greatest(F.ceil(F.col("total") * F.lit(float(p))), F.lit(1)) for name, p in quantiles.items()}
    return counts.groupBy(group).agg(*[
        F.max(F.when((F.col("before") < r) & (F.col("before") + F.col("n") >= r), F.col(value))).alias(name)
        for name, r in at.items()])
